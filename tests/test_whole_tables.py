"""Queries over whole tables: rows far beyond the first ids count like any others."""

import duckdb
import pytest

from quire.plans import library
from tests.oracle import same

SOURCE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """A few rows from all over the tables, so that high ids are among them."""
    path = tmp_path_factory.mktemp("sparse")
    con = duckdb.connect()
    for name, rows in (("part", "p_partkey % 7 = 0"), ("orders", "o_orderkey % 25 = 0"), ("lineitem", "l_orderkey % 25 = 0")):
        con.execute(f"COPY (SELECT * FROM '{SOURCE}/{name}.parquet' WHERE {rows}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), con


def test_merged_crossings_of_all_lines(spark, sparse):
    path, con = sparse
    lines = con.sql("SELECT l_suppkey % 40, l_linenumber, l_partkey * 13 % 200, l_partkey * 13 % 200 + CAST(l_quantity AS BIGINT) % 4, l_orderkey % 3 - 1 FROM lineitem ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice").fetchall()
    assert con.sql("SELECT max(l_orderkey) FROM lineitem").fetchall()[0][0] > 600
    merged = {}
    for paint, y, lo, hi, cnt in lines:
        row = merged.setdefault((paint, y), [])
        if row and row[-1][1] + 1 >= lo and row[-1][0] <= hi + 1:
            row[-1] = (min(row[-1][0], lo), max(row[-1][1], hi), row[-1][2] + cnt)
        else:
            row.append((lo, hi, cnt))
    want = [(*key, k, *entry) for key, row in merged.items() for k, entry in enumerate(row)]
    got = library.queries()["merged_crossings"](spark, path).select("paint", "y", "k", "lo", "hi", "cnt").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def same_without(spark, sparse, name, cut):
    """Compares a query with its SQL less the filter ``cut``, if that is there."""
    path, con = sparse
    same(library.queries()[name](spark, path), con, library.oracle_sql()[name].replace(cut, ""))


@pytest.mark.parametrize("name", ["jitter_coverage_64", "jitter_coverage_eo", "analytic_coverage"])
def test_coverage_of_all_parts(spark, sparse, name):
    same_without(spark, sparse, name, " WHERE p_partkey < 400")


@pytest.mark.parametrize("name", ["pdf_text_extract", "pdf_text_pens", "pdf_prescan"])
def test_texts_of_all_parts(spark, sparse, name):
    same_without(spark, sparse, name, " WHERE p_partkey < 500")


@pytest.mark.parametrize("name, cut", [("pdf_info", " WHERE o_orderkey < 2000"), ("pdf_page_tree", " WHERE o_orderkey < 2000"), ("pdf_rendered_colors", " WHERE p_partkey < 300")])
def test_documents_of_all_rows(spark, sparse, name, cut):
    same_without(spark, sparse, name, cut)


def test_blit_of_all_parts(spark, sparse):
    same_without(spark, sparse, "image_nearest_blit", " WHERE p_partkey < 200")


def test_forms_of_all_parts(spark, sparse, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SOURCE}/part.parquet' WHERE p_partkey < 300 OR p_partkey BETWEEN 600 AND 610) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    forms = {k for (k,) in con.sql(f"SELECT p_partkey FROM '{tmp_path}/part.parquet'").fetchall()}
    want = []

    def draw(root, form, path, above):
        want.append((root, form, ".".join(path)))
        if len(above) <= 9:
            for ord_, child in enumerate([form * 2 + 1, form * 2 + 2] + [form // 4] * (form % 16 == 5)):
                if child in forms and child not in above:
                    draw(root, child, [*path, str(ord_)], [*above, child])

    for k in forms:
        draw(k, k, [], [k])
    got = library.queries()["form_expansion"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_references_of_all_parts(spark, sparse):
    path, con = sparse
    size = dict(con.sql("SELECT p_partkey, p_size FROM part").fetchall())
    want = []
    for obj in size:
        at, hops = obj, 0
        while at in size and size[at] % 9 != 0 and hops <= 32:
            at, hops = at - at % 997 + (at % 997 * 5 + 3) % 997, hops + 1
        ends = at in size and size[at] % 9 == 0 and hops <= 32
        want.append((obj, at if ends else -1, hops if ends else -1))
    got = library.queries()["reference_chase"](spark, path).select("obj", "target", "hops").collect()
    assert max(size) > 997 and sorted(map(tuple, got)) == sorted(want)


def test_guards_of_all_orders(spark, sparse, tmp_path):
    con = sparse[1]
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 3 ELSE o_custkey END AS o_custkey) FROM orders) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE OR REPLACE VIEW narrow AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = library.queries()["page_pixel_guards"](spark, str(tmp_path))
    assert got.where("w < 0").count() > 0
    same(got, con, library.oracle_sql()["page_pixel_guards"].replace(" WHERE o_custkey % 12000 >= 3", "").replace("FROM orders", "FROM narrow"))
