"""Queries against their SQL on small tables of texts that the smallest test tables lack."""

import duckdb
import pytest

from colloquy import catalog

TEXTS = ("straße spieße fleiße dreiße", "stra spie flei drei", "keit für Für", "a b c d e\nf g h i", "a b c d e f\ng h", "a b c d e f g h\ni")


@pytest.mark.parametrize("name", ["episode_threads", "expanded_replies", "filled_slots"])
def test_texts_with_marks_and_line_ends(spark, tmp_path, name):
    turns = [(c, t, "assistant" if t % 2 else "user", TEXTS[(c // 40 + t) % len(TEXTS)]) for c in range(240) for t in range(8)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall())
