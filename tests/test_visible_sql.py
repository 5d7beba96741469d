"""The SQL of visible_text decodes what the query decodes."""

import random

import duckdb

from offerlens.plans import text_queries

PIECES = (
    "&amp", "&", "&lt;", "&ltfoo", "&notin;", "&notit;", "&#65;", "&#x41", "&#X1F600;", "&#0;", "&#xD800;", "&#150;", "&#00000000065;", "&#99999999999;", "&;", "amp;", "&nbsp;", "&nbsp", " ", " ", "　", "\t", "\n", "é",
    "<br>", "</h2>", "<noscript>a</noscript>", "<script>x</script>", "<style>", "</style>", '<p class="a">', "</p>", "<", ">", "&copy2;", "&bne;", ";", "&#x;", "1",
)


def test_visible_text_is_its_sql_on_odd_references(spark, tmp_path):
    pick = random.Random(1)
    rows = [(0, "u", None), (1, "u", "and&&&amp To")] + [(i, "u", "".join(pick.choice(PIECES) for _ in range(pick.randint(0, 20)))) for i in range(2, 800)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(duck.execute(text_queries.ORACLES["visible_text"]).fetchall())
    assert dict(text_queries.visible_text(spark, str(tmp_path)).collect()) == want and want[1] == "and&&& To"
