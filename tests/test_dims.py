"""Dimensions, promotions and integrity reports."""

import datetime as dt

from tidewater.operators import dims, promotions, quality

PROMO = "promotion_id string, promotion_name string, start_date string, end_date string, " \
        "discount_percentage string, target_type string, target_id string"


def test_promotion_rows(spark):
    raw = spark.createDataFrame([
        ("P1", "spring", "2024-03-01", "2024-03-06", "10", "category", "C1"),
        ("P2", "bad date", "2024-13-01", "2024-03-06", "10", "category", "C1"),
        ("P3", "bad disc", "2024-03-01", "2024-03-06", "ten", "category", "C1"),
        ("P4", "reversed", "2024-03-06", "2024-03-01", "20", "product", "X9"),
    ], PROMO)
    got = {r.promotion_id for r in dims.dim_promotions(raw).collect()}
    assert got == {"P1", "P4"}
    # one fractional discount refuses the whole file
    frac = raw.union(spark.createDataFrame(
        [("P5", "frac", "2024-03-01", "2024-03-02", "12.5", "category", "C1")], PROMO))
    assert dims.dim_promotions(frac).count() == 0


def test_targets_and_days(spark):
    promos = dims.dim_promotions(spark.createDataFrame([
        ("P1", "a", "2024-03-01", "2024-03-03", "10", "category", "C1"),
        ("P2", "b", "2024-03-02", "2024-03-02", "10", "product", "X1"),
        ("P3", "c", "2024-03-05", "2024-03-01", "10", "product", "X1"),   # reversed: no days
        ("P4", "a", "2024-03-03", "2024-03-04", "10", "category", "C1"),  # overlaps P1, same name
        ("P5", "d", "2024-03-01", "2024-03-01", "10", "region", "C1"),     # other type: nothing
        ("P6", "e", "2024-03-01", "2024-03-01", "10", "product", "NOPE"),  # unknown product
    ], PROMO))
    products = spark.createDataFrame([("X1", "x", "d", "C2"), ("X2", "y", "d", "C1")],
                                     "product_id string, product_name string, "
                                     "description string, category_id string")
    t = {(r.category_id, r.promotion_id) for r in
         promotions.promotion_targets(promos, products).collect()}
    assert t == {("C1", "P1"), ("C2", "P2"), ("C2", "P3"), ("C1", "P4")}
    days = promotions.promotion_days(promotions.promotion_targets(promos, products))
    assert days.where("promotion_id = 'P1'").count() == 3
    assert days.where("promotion_id = 'P3'").count() == 0
    feats = {(r.category_id, r.promotion_name, r.ds) for r in
             promotions.promotion_features(days).collect()}
    # P1 and P4 share name "a" and overlap on 03-03: one row for that day
    assert sorted(d for c, n, d in feats if n == "a") == [
        dt.date(2024, 3, 1), dt.date(2024, 3, 2), dt.date(2024, 3, 3), dt.date(2024, 3, 4)]


def test_integrity_reports(spark):
    cats = spark.createDataFrame([("C1", "one")], "category_id string, category_name string")
    prods = spark.createDataFrame([("X1", "x", "d", "C1"), ("X2", "y", "d", "C9"),
                                   ("X3", "z", "d", "C9")],
                                  "product_id string, product_name string, description string, "
                                  "category_id string")
    orph = quality.fk_orphans(prods, cats, "category_id", "category_id", "p->c").collect()
    assert [(r.key, r.n_rows) for r in orph] == [("C9", 2)]
    dup = quality.duplicate_keys(prods, ["category_id"], "products").collect()
    assert [(r.key, r.n_rows) for r in dup] == [("C9", 2)]
    sales = spark.createDataFrame([("X1", "C1"), ("X1", "C2"), ("X2", "C9")],
                                  "product_id string, category_id string")
    mm = quality.category_mismatch(sales, prods).collect()
    assert [(r.sale_category, r.product_category, r.n_lines) for r in mm] == [("C2", "C1", 1)]


def test_catalog_reads(spark):
    prods = spark.createDataFrame([("X1", "b", "d", "C1"), ("X2", "a", "d", "C2")],
                                  "product_id string, product_name string, description string, "
                                  "category_id string")
    assert [r.product_id for r in dims.products_by_category(prods).collect()] == ["X2", "X1"]
    assert [r.product_id for r in dims.products_by_category(prods, "C1").collect()] == ["X1"]
