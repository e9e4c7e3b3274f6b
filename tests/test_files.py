"""File-level loading: per-file atomicity, ledger, idempotent merge."""

import os
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import write_text
from tidewater import store
from tidewater.model.stats import training_frame
from tidewater.operators import ingest
from tidewater.plans import etl
from tidewater.sources import sales_files

HEADER = "transaction_id,product_id,category_id,quantity,price_per_unit,timestamp\n"


def good(n, hour="10", cat="C1"):
    return "".join(f"t{i},P1,{cat},1,2.50,2024-01-01T{hour}:0{i % 10}:00\n" for i in range(n))


def test_file_status(spark, tmpdir_path):
    d = tmpdir_path
    write_text(f"{d}/2024-01-01.csv", HEADER + good(3))
    write_text(f"{d}/2024-01-02.csv", HEADER + good(2) + "x,P1,C1,1,2.5\n")          # 5 fields
    write_text(f"{d}/2024-01-03.csv", HEADER + good(2) + "x,P1,C1,1,2.5,2024-01-01T10:00:00,9\n")
    write_text(f"{d}/2024-01-04.csv", HEADER)                                        # header only
    write_text(f"{d}/2024-01-05.csv", HEADER + 'x,P1,C1,1,2.5,2024-01-01T10:00"00\n')  # stray quote
    write_text(f"{d}/notes.txt", "ignored")
    st = {r.file_name: r.status for r in
          sales_files.scan_quality(spark, d).collect()}
    assert st == {"2024-01-01.csv": "SUCCESS", "2024-01-02.csv": "FAILED",
                  "2024-01-03.csv": "FAILED", "2024-01-04.csv": "SUCCESS",
                  "2024-01-05.csv": "FAILED"}
    listed = {r.file_name for r in sales_files.list_sales_files(spark, d).collect()}
    assert "notes.txt" not in listed and len(listed) == 5


def test_header_width(spark, tmpdir_path):
    d = tmpdir_path
    write_text(f"{d}/a.csv", HEADER + good(1))
    write_text(f"{d}/b.csv", "a,b,c\n1,2,3\n")
    w = {r.file_name: r.header_width for r in sales_files.header_widths(spark, d).collect()}
    assert w == {"a.csv": 6, "b.csv": 3}


def test_file_rules_of_the_load(spark, tmpdir_path):
    """One file per rule: what a strict CSV reader with a header line makes of it."""
    d = f"{tmpdir_path}/sales"
    stamp = "2024-01-01T10:00:00"
    cases = {
        "blank_first": ("\n" + HEADER + good(2), "SUCCESS", 2),
        "blank_inside": (HEADER + good(1) + "\n\n" + good(1, hour="11"), "SUCCESS", 2),
        "escaped": (HEADER + f't,"P ""x""",C1,1,2.5,{stamp}\n', "SUCCESS", 1),
        "quoted_header": ('"transaction,id",b,c,d,e,f\n' + good(1), "SUCCESS", 1),
        "line_break": (HEADER + f't,"P\n1",C1,1,2.5,{stamp}\n' + good(1), "SUCCESS", 2),
        "crlf": (HEADER.replace("\n", "\r\n") + good(2).replace("\n", "\r\n"), "SUCCESS", 2),
        "open_quote": (HEADER + f't,"P1,C1,1,2.5,{stamp}\n', "FAILED", 0),
        "after_quote": (HEADER + f't,"P"1,C1,1,2.5,{stamp}\n', "FAILED", 0),
        "short_header": ("a,b\n1,2\n", "SUCCESS", 0),
        "short_ragged": ("a,b\n1,2\n1,2,3\n", "FAILED", 0),
        "no_header": (good(3), "SUCCESS", 2),
        "header_only": (HEADER, "SUCCESS", 0),
        "empty": ("", "FAILED", 0),
        "only_blank": ("\n\n", "FAILED", 0),
        "no_last_newline": (HEADER + good(2)[:-1], "SUCCESS", 2),
        "empty_category": (HEADER + f"t,P1,,1,2.5,{stamp}\n", "SUCCESS", 1),
        "long_lines": (HEADER.strip() + ",x\n" + f"t,P1,C1,1,2.5,{stamp},9\n", "SUCCESS", 1),
    }
    for name, (text, _, _) in cases.items():
        write_text(f"{d}/{name}.csv", text)
    fact, ledger = f"{tmpdir_path}/fact", f"{tmpdir_path}/ledger"
    out = {r.file_name[:-4]: (r.status, r.n_valid) for r in etl.load_sales(
        spark, d, fact, ledger, "2024-02-01 00:00:00").collect()}
    assert out == {k: v[1:] for k, v in cases.items()}
    deltas = spark.read.parquet(fact).where("time IS NOT NULL")
    assert {r.category_id for r in deltas.where("source_file = 'empty_category.csv'").collect()} == {""}
    assert etl.load_sales(spark, d, fact, ledger, "2024-02-02 00:00:00").count() == 5  # FAILED ones


def test_sales_of_any_size_are_in_the_fact(spark, tmpdir_path):
    stamp = "2024-01-01T10:00:00"
    rows = [("1", "2.5"), ("100000000000", "1"), ("1", "1e20"), ("-1", "1e20"), ("1000000000000", "0"),
            ("99999999999", "9999999999999"), ("3", "1e-15"), ("2", "1e400"), ("2", "1e-400")]
    text = "".join(f"t{i},P1,C1,{q},{p},{stamp}\n" for i, (q, p) in enumerate(rows))
    for name, body in {"a": HEADER + text, "first_is_header": text[text.index("t2"):],
                       "failed": HEADER + text + "x,y\n"}.items():
        write_text(f"{tmpdir_path}/in/{name}.csv", body)
    out = {r.file_name: (r.status, r.n_records, r.n_valid, r.n_wide) for r in etl.load_sales(
        spark, f"{tmpdir_path}/in", f"{tmpdir_path}/f", f"{tmpdir_path}/l", "2024-02-01 00:00:00").collect()}
    assert out == {"a.csv": ("SUCCESS", 9, 5, 4), "first_is_header.csv": ("SUCCESS", 6, 2, 2),
                   "failed.csv": ("FAILED", 10, 0, 0)}
    got = store.read_fact(spark, f"{tmpdir_path}/f").collect()
    a_total = Fraction("2.5") + 10 ** 11 + 10 ** 20 + 99999999999 * 9999999999999
    total = a_total + 99999999999 * 9999999999999
    assert [Fraction(r.total_sales) for r in got] == [total]
    assert got[0].total_value == pytest.approx(float(total), rel=1e-15)
    assert got[0].total_quantity == 1 + 10 ** 11 + 1 + 2 * 99999999999 + 2 * 3


def test_totals_are_exact_and_do_not_depend_on_the_split(spark, tmpdir_path):
    """Prices from 1e-300 to 1e280 and quantities up to the largest long, in one file and in seven,
    against fractions; neither the cents of a large total nor tiny sales are lost on the way."""
    rng = random.Random(5)
    prices = ["0.000000000001", "0.1", "1e-15", "2.5e-300", "123456789012345678", "1e13", "4.25",
              "0.12345678901234567", "9999999999999.5", "7e18"]
    lines = [(rng.choice([1, 7, 10 ** 8, 5 * 10 ** 9 + 1, 2 ** 63 - 1]), p, c)
             for p in prices for c in ("C1", "C2") for _ in range(3)]
    lines += [(2 ** 63 - 1, p, "C3") for p in ("1e280", "1e-300", "3")] + [(1, "1e-15", "C4")] * 2000
    lines += [(3, "1e20", "C5"), (7, "0.12345678901234567", "C5"), (5 * 10 ** 9 + 1, "0.1", "C5")]
    rng.shuffle(lines)
    row = lambda i, x: f"t{i},P1,{x[2]},{x[0]},{x[1]},2024-01-01T10:00:00\n"
    facts = []
    for parts in (1, 7):
        root = f"{tmpdir_path}/{parts}"
        for k in range(parts):
            write_text(f"{root}/in/f{k}.csv", HEADER + "".join(
                row(i, x) for i, x in enumerate(lines) if i % parts == k))
        etl.load_sales(spark, f"{root}/in", f"{root}/f", f"{root}/l", "2024-02-01 00:00:00")
        facts.append({r.category_id: r for r in store.read_fact(spark, f"{root}/f").collect()})
    assert facts[0] == facts[1]
    for cat, r in facts[0].items():
        total = sum(q * Fraction(repr(float(p))) for q, p, c in lines if c == cat)
        assert r.total_value == pytest.approx(float(total), rel=1e-14)
        if total < 10 ** 25:
            assert abs(Fraction(r.total_sales) - total) < Fraction(1, 10 ** 11)
        else:
            assert r.total_sales is None
    assert facts[0]["C4"].total_sales == Decimal("2e-12")
    assert facts[0]["C3"].total_quantity is None and facts[0]["C4"].total_quantity == 2000
    y = {r.category_id: r.y for r in training_frame(
        store.read_fact(spark, f"{tmpdir_path}/1/f")).collect()}
    assert y["C3"] == pytest.approx((2 ** 63 - 1) * 1e280, rel=1e-14)


def _strict_records(text: str) -> list[list[str]]:
    """Records of a whole file; raises ValueError on bad quoting. Quoted line breaks belong to
    the field, blank lines are skipped, a carriage return before a line feed is dropped."""
    text = text.replace("\r\n", "\n")
    records, at, n = [], 0, len(text)
    while at < n:
        if text[at] == "\n":
            at += 1
            continue
        record = []
        while True:
            if at < n and text[at] == '"':
                parts, at = [], at + 1
                while True:
                    end = text.find('"', at)
                    if end < 0:
                        raise ValueError("quote without an end")
                    parts.append(text[at:end])
                    at = end + 1
                    if not text.startswith('"', at):
                        break
                    parts.append('"')
                    at += 1
                if at < n and text[at] not in ",\n":
                    raise ValueError("text after a closing quote")
                record.append("".join(parts))
            else:
                ends = [e for e in (text.find(",", at), text.find("\n", at)) if e >= 0]
                end = min(ends, default=n)
                if '"' in text[at:end]:
                    raise ValueError("quote inside a plain field")
                record.append(text[at:end])
                at = end
            if at < n and text[at] == ",":
                at += 1
                continue
            at += 1
            break
        records.append(record)
    return records


def test_quoted_files_are_split(spark, tmpdir_path):
    """Records of files in small blocks, against a reader of the whole text; the largest value in
    the plan is a line, and no file is one row."""
    rng = random.Random(3)
    texts = {f"f{k}.csv": "".join(rng.choice(['"', '"', '""', ",", "\n", "\r\n", "a", "bc"])
                                  for _ in range(rng.randint(1, 14))) for k in range(150)}
    pieces = ["x", '"q"', '"a\nb"', '"a\r\n\n,""c"', '""', "", '"y""\nz"']
    for k in range(60):
        lines = [",".join(rng.choice(pieces) for _ in range(3)) for _ in range(rng.randint(1, 9))]
        texts[f"g{k}.csv"] = "\n".join(lines) + rng.choice(["", "\n", ',"open'])
    texts["long.csv"] = HEADER + 't,"P\n1",C1,1,2.5,x\n' + good(300) + 't,"P\n\n2",C1,1,2,x\n'
    want = {}
    for name, text in texts.items():
        with open(f"{tmpdir_path}/{name}", "w", newline="") as f:
            f.write(text)
        try:
            want[name] = _strict_records(text)
        except ValueError:
            want[name] = None
    paths = [f"{tmpdir_path}/{n}" for n in texts]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = sales_files.read_whole(spark, paths)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in sorted(df.collect(), key=lambda r: r.place):
            got.setdefault(r.file_name, []).append(r.fields if r.whole else None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "MapInArrow" not in plan
    for name, records in want.items():
        assert got.get(name, []) == ([None] if records is None else records), texts[name]


def test_long_fields_and_many_fields_need_no_stack(spark, tmpdir_path):
    """Quoted fields of a megabyte (doubled quotes, commas, line breaks inside), 200,000 fields,
    and their broken versions: split or refused like short ones."""
    big = 'x""y,' * 200_000
    texts = {
        "field.csv": f'a,b\n1,"{big}"\n',
        "breaks.csv": f'a,b\n"{big}\n{big}\n",2\n3,4\n',
        "wide.csv": ",".join(["1"] * 200_000) + "\n" + ",".join(['"2"'] * 200_000) + "\n",
        "wide_breaks.csv": ",".join(['"2"'] * 100_000) + ',"a\nb"' + ',"c"' * 100_000 + "\n",
        "between.csv": '"a\nb",c' + ",d" * 50_000 + ',"e\nf"\n',
        "open.csv": f'a,b\n1,"{big}\n',
        "after.csv": f'a,b\n1,"{big}"z\n',
    }
    want = {}
    for name, text in texts.items():
        with open(f"{tmpdir_path}/{name}", "w", newline="") as f:
            f.write(text)
        try:
            want[name] = _strict_records(text)
        except ValueError:
            want[name] = None
    paths = [f"{tmpdir_path}/{n}" for n in texts]
    got = {}
    for r in sorted(sales_files.read_whole(spark, paths).collect(), key=lambda r: r.place):
        got.setdefault(r.file_name, []).append(r.fields if r.whole else None)
    for name, records in want.items():
        assert got[name] == ([None] if records is None else records), name
    lines = {(r.file_name, r.whole) for r in sales_files.read_lines(spark, paths).collect()}
    assert ("field.csv", True) in lines and ("wide.csv", True) in lines
    assert ("breaks.csv", False) in lines and ("after.csv", False) in lines


def test_rewritten_file_without_valid_rows_clears_its_delta(spark, tmpdir_path):
    d, fact, ledger = (f"{tmpdir_path}/{x}" for x in ("sales", "fact", "ledger"))
    write_text(f"{d}/a.csv", HEADER + good(2))
    os.utime(f"{d}/a.csv", (1_700_000_000, 1_700_000_000))
    etl.load_sales(spark, d, fact, ledger, "2024-02-01 00:00:00", by_name_only=False)
    assert store.read_fact(spark, fact).count() == 1
    write_text(f"{d}/a.csv", HEADER + "x,P1,C1,0,1,2024-01-01T10:00:00\n")
    os.utime(f"{d}/a.csv", (1_700_000_500, 1_700_000_500))
    etl.load_sales(spark, d, fact, ledger, "2024-02-02 00:00:00", by_name_only=False)
    assert store.read_fact(spark, fact).count() == 0


def test_ledger_latest_and_pending(spark):
    rows = [(1, "f1", "FAILED", "2024-01-01 00:00:00"), (2, "f1", "SUCCESS", "2024-01-02 00:00:00"),
            (3, "f2", "SUCCESS", "2024-01-01 00:00:00"), (4, "f2", "FAILED", "2024-01-03 00:00:00"),
            (5, "f3", "SUCCESS", "2024-01-01 00:00:00"), (6, "f3", "PENDING", "2024-01-01 00:00:00")]
    ledger = spark.createDataFrame(rows, "id long, file_name string, status string, last_updated string") \
        .withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))
    latest = {r.file_name: r.status for r in ingest.ledger_latest(ledger).collect()}
    assert latest == {"f1": "SUCCESS", "f2": "FAILED", "f3": "PENDING"}
    listing = spark.createDataFrame([("f1.csv",), ("f2.csv",), ("f3.csv",), ("f4.csv",),
                                     ("f5.txt",)], "file_name string")
    todo = {r.file_name for r in ingest.files_to_process(listing, ledger).collect()}
    assert todo == {"f2.csv", "f3.csv", "f4.csv"}


def _fact(spark, path):
    return {(str(r.time), r.category_id): (float(r.total_sales), r.total_quantity)
            for r in store.read_fact(spark, path).collect()}


def test_load_is_idempotent_and_additive(spark, tmpdir_path):
    d = f"{tmpdir_path}/sales"
    fact, ledger = f"{tmpdir_path}/fact", f"{tmpdir_path}/ledger"
    write_text(f"{d}/2024-01-01.csv", HEADER + good(3))
    write_text(f"{d}/2024-01-02.csv", HEADER + good(2))        # same hour + category: adds
    write_text(f"{d}/2024-01-03.csv", HEADER + "x,P1,C1,1\n")  # malformed: FAILED
    out = {r.file_name: r.status for r in etl.load_sales(spark, d, fact, ledger,
                                                         "2024-02-01 00:00:00").collect()}
    assert out == {"2024-01-01.csv": "SUCCESS", "2024-01-02.csv": "SUCCESS",
                   "2024-01-03.csv": "FAILED"}
    first = _fact(spark, fact)
    assert first == {("2024-01-01 10:00:00", "C1"): (12.5, 5)}
    # second cycle: only the FAILED file is retried; fact unchanged
    again = {r.file_name for r in etl.load_sales(spark, d, fact, ledger,
                                                 "2024-02-02 00:00:00").collect()}
    assert again == {"2024-01-03.csv"}
    assert _fact(spark, fact) == first
    # fix the failed file: its delta is added once
    write_text(f"{d}/2024-01-03.csv", HEADER + good(1, hour="11"))
    etl.load_sales(spark, d, fact, ledger, "2024-02-03 00:00:00")
    assert _fact(spark, fact)[("2024-01-01 11:00:00", "C1")] == (2.5, 1)
    # reloading everything from scratch (ledger lost) replaces deltas, never doubles
    etl.load_sales(spark, d, fact, f"{tmpdir_path}/ledger2", "2024-02-04 00:00:00")
    assert _fact(spark, fact)[("2024-01-01 10:00:00", "C1")] == (12.5, 5)


def test_split_file_equals_one_file(spark, tmpdir_path):
    one, two = f"{tmpdir_path}/one", f"{tmpdir_path}/two"
    write_text(f"{one}/a.csv", HEADER + good(4) + good(3, hour="12", cat="C2"))
    write_text(f"{two}/a.csv", HEADER + good(4))
    write_text(f"{two}/b.csv", HEADER + good(3, hour="12", cat="C2"))
    f1, f2 = f"{tmpdir_path}/f1", f"{tmpdir_path}/f2"
    etl.load_sales(spark, one, f1, f"{tmpdir_path}/l1", "2024-02-01 00:00:00")
    etl.load_sales(spark, two, f2, f"{tmpdir_path}/l2", "2024-02-01 00:00:00")
    assert _fact(spark, f1) == _fact(spark, f2)


def test_short_header_skips_rows(spark, tmpdir_path):
    d = f"{tmpdir_path}/sales"
    write_text(f"{d}/short.csv", "a,b,c\nt1,P1,C1\n")
    out = {r.file_name: r.status for r in etl.load_sales(
        spark, d, f"{tmpdir_path}/fact", f"{tmpdir_path}/ledger", "2024-02-01").collect()}
    assert out == {"short.csv": "SUCCESS"}
    assert store.read_fact(spark, f"{tmpdir_path}/fact").count() == 0


def test_rewritten_file_reloads_by_mtime(spark, tmpdir_path):
    d = f"{tmpdir_path}/sales"
    fact, ledger = f"{tmpdir_path}/fact", f"{tmpdir_path}/ledger"
    write_text(f"{d}/a.csv", HEADER + good(2))
    os.utime(f"{d}/a.csv", (1_700_000_000, 1_700_000_000))
    etl.load_sales(spark, d, fact, ledger, "2024-02-01 00:00:00", by_name_only=False)
    # same name, new content and modification time: loaded again, delta replaced
    write_text(f"{d}/a.csv", HEADER + good(5))
    os.utime(f"{d}/a.csv", (1_700_000_500, 1_700_000_500))
    assert {r.file_name for r in etl.pending_files(spark, d, ledger).collect()} == set()
    assert {r.file_name for r in etl.pending_files(spark, d, ledger, by_name_only=False)
            .collect()} == {"a.csv"}
    etl.load_sales(spark, d, fact, ledger, "2024-02-02 00:00:00", by_name_only=False)
    assert _fact(spark, fact) == {("2024-01-01 10:00:00", "C1"): (12.5, 5)}


def test_metadata_refresh_all_or_nothing(spark, tmpdir_path):
    cats = spark.createDataFrame([("C1", "one")], "category_id string, category_name string")
    good_p = spark.createDataFrame([("X1", "x", "d", "C1")], "product_id string, "
                                   "product_name string, description string, category_id string")
    bad_p = spark.createDataFrame([("X1", "x", "d", "C1"), ("X2", "y", "d", "C9")],
                                  good_p.schema)
    cp, pp, lp = f"{tmpdir_path}/cats", f"{tmpdir_path}/prods", f"{tmpdir_path}/ledger"
    assert etl.refresh_metadata(spark, cats, good_p, cp, pp, lp, "2024-01-01").count() == 0
    assert store.read_current(spark, pp).count() == 1
    assert etl.refresh_metadata(spark, cats, bad_p, cp, pp, lp, "2024-01-02").count() == 1
    assert store.read_current(spark, pp).count() == 1          # previous snapshot kept
    latest = {r.file_name: r.status for r in
              ingest.ledger_latest(spark.read.parquet(lp)).collect()}
    assert latest == {"categories.csv": "FAILED", "products.csv": "FAILED"}


def test_promotions_file_refused(spark, tmpdir_path):
    schema = ("promotion_id string, promotion_name string, start_date string, "
              "end_date string, discount_percentage string, target_type string, "
              "target_id string")
    ok = spark.createDataFrame([("P1", "a", "2024-03-01", "2024-03-02", "10", "category",
                                 "C1")], schema)
    frac = ok.union(spark.createDataFrame([("P2", "b", "2024-03-01", "2024-03-02", "12.5",
                                            "category", "C1")], schema))
    pp, lp = f"{tmpdir_path}/promos", f"{tmpdir_path}/ledger"
    etl.load_promotions(spark, ok, pp, lp, "2024-01-01")
    etl.load_promotions(spark, frac, pp, lp, "2024-01-02")
    assert store.read_current(spark, pp).count() == 1
    assert {r.status for r in ingest.ledger_latest(spark.read.parquet(lp)).collect()} == {"FAILED"}


def test_dimension_files(spark, tmpdir_path):
    d = tmpdir_path
    write_text(f"{d}/categories.csv", "category_id,category_name\nC1,One\nC2,Two\n")
    write_text(f"{d}/products.csv", "product_id,product_name,description,category_id\n"
               "X1,Thing,desc,C1\nX2,\"Other, big\",\"quoted \"\"d\"\"\",C2\n")
    write_text(f"{d}/bad_products.csv", "product_id,product_name,description,category_id\n"
               "X1,Thing,desc\n")
    lp = f"{d}/ledger"
    assert etl.refresh_metadata_files(spark, f"{d}/categories.csv", f"{d}/products.csv",
                                      f"{d}/cats", f"{d}/prods", lp, "2024-01-01") == "SUCCESS"
    prods = {r.product_id: (r.product_name, r.description)
             for r in store.read_current(spark, f"{d}/prods").collect()}
    assert prods["X2"] == ("Other, big", 'quoted "d"')
    assert etl.refresh_metadata_files(spark, f"{d}/categories.csv", f"{d}/bad_products.csv",
                                      f"{d}/cats", f"{d}/prods", lp, "2024-01-02") == "FAILED"
    assert store.read_current(spark, f"{d}/prods").count() == 2
    write_text(f"{d}/promotions.csv", "promotion_id,promotion_name,start_date,end_date,"
               "discount_percentage,target_type,target_id\n"
               "P1,a,2024-03-01,2024-03-06,10,category,C1\nP2,b,2024-99-01,2024-03-06,10,category,C1\n")
    assert etl.load_promotions_file(spark, f"{d}/promotions.csv", f"{d}/promos", lp,
                                    "2024-01-03") == "SUCCESS"
    assert [r.promotion_id for r in store.read_current(spark, f"{d}/promos").collect()] == ["P1"]


def test_fact_time_range_read_is_pushed_down(spark, tmpdir_path):
    d = f"{tmpdir_path}/sales"
    fact = f"{tmpdir_path}/fact"
    write_text(f"{d}/a.csv", HEADER + good(2, hour="10") + good(2, hour="12"))
    etl.load_sales(spark, d, fact, f"{tmpdir_path}/ledger", "2024-02-01 00:00:00")
    df = store.read_fact(spark, fact, "2024-01-01 11:00:00", "2024-01-01 13:00:00")
    assert {str(r.time) for r in df.collect()} == {"2024-01-01 12:00:00"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time" in plan


def test_repeated_keys_refuse_a_dimension_load(spark, tmpdir_path):
    cats = spark.createDataFrame([("C1", "one"), ("C1", "uno")], "category_id string, category_name string")
    prods = spark.createDataFrame([("X1", "", "d", "C1")], "product_id string, product_name string, "
                                  "description string, category_id string")
    c, p, ledger = (f"{tmpdir_path}/{x}" for x in ("c", "p", "l"))
    report = etl.refresh_metadata(spark, cats, prods, c, p, ledger, "2024-01-01 00:00:00")
    assert [(r.relation, r.key) for r in report.collect()] == [("categories", "C1")]
    assert store.read_current(spark, c) is None
    fine = cats.where("category_name = 'one'")
    assert etl.refresh_metadata(spark, fine, prods, c, p, ledger, "2024-01-02 00:00:00").isEmpty()
    assert [r.product_name for r in store.read_current(spark, p).collect()] == [""]
    twice = spark.createDataFrame([("P1", "a", "2024-01-01", "2024-01-02", "5", "category", "C1")] * 2,
                                  "promotion_id string, promotion_name string, start_date string, "
                                  "end_date string, discount_percentage string, target_type string, "
                                  "target_id string")
    promos = f"{tmpdir_path}/promos"
    etl.load_promotions(spark, twice, promos, ledger, "2024-01-03 00:00:00")
    assert store.read_current(spark, promos) is None
