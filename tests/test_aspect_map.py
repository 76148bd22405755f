"""The aspect map names, for every aspect of a paragraph, the paragraph itself."""

import duckdb

from tidemark.plans.catalog import ORACLES, QUERIES
from tools.oracle_check import digest


def test_aspect_map_holds_the_paragraphs_text(spark, tmp_dir):
    rows = [(1, "Quiet day.\n\nRevenue   growth\tand a lawsuit"), (2, None), (3, "  \n\n "), (4, "Guidance was raised")]
    spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).write.parquet(f"{tmp_dir}/documents.parquet")
    got = QUERIES["aspect_map"](spark, tmp_dir)
    assert got.columns == ["doc_id", "paragraph_id", "ticker", "date", "aspect", "n_chars", "text"]
    found = [tuple(r) for r in got.collect()]
    texts = {(r[0], r[1]): r[6] for r in found}
    assert texts[1, 2] == "Revenue growth and a lawsuit" and texts[4, 1] == "Guidance was raised"
    assert all(r[5] == len(r[6]) for r in found)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/documents.parquet/*.parquet')")
    cur = con.execute(ORACLES["aspect_map"])
    names = [c[0] for c in cur.description]
    assert names == got.columns and digest(found, names)[0] == digest(cur.fetchall(), names)[0]
