"""Every query of the core library against its SQL."""

import pytest

from tidewater import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


def table_rows(table, columns):
    return sorted((tuple(r[c] for c in columns) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toArrow(), duck.sql(SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert [got.schema.field(c).type for c in columns] == [want.schema.field(c).type for c in columns]
    assert table_rows(got, columns) == table_rows(want, columns)


def replay_windows(rows, limit, seconds):
    state, over = {}, set()
    for user, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        start, n = state.get(user, (None, 0))
        if start is None or (at - start).total_seconds() >= seconds:
            start, n = at, 0
        state[user] = (start, n + 1)
        if n + 1 > limit:
            over.add((user, i))
    return over


def replay_lockouts(rows, failures, seconds):
    state, hit = {}, set()
    for user, at, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        fails, until = state.get(user, (0, None))
        if until is not None and at < until:
            hit.add((user, i))
            continue
        if ok:
            state[user] = (0, None)
        elif fails + 1 >= failures:
            from datetime import timedelta

            state[user] = (0, at + timedelta(seconds=seconds))
        else:
            state[user] = (fails + 1, None)
    return hit


def test_rate_limit_replays(spark, sf_dir, duck):
    rows = duck.sql("select user_id, ts, event_id from events").fetchall()
    got = {tuple(r) for r in QUERIES["rate_limited"](spark, sf_dir).collect()}
    assert got == replay_windows(rows, 5, 86_400) and got


def test_lockouts_replay(spark, sf_dir, duck):
    rows = duck.sql("select user_id, ts, event_id, event_type = 'purchase' from events").fetchall()
    got = {tuple(r) for r in QUERIES["lockouts"](spark, sf_dir).collect()}
    assert got == replay_lockouts(rows, 5, 86_400) and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_all_similar_titles(spark, tmp_path):
    from itertools import combinations

    from tidewater.functions import text as X
    from tidewater.queries import texts

    titles = ["Orange", "orange", "Orange lamp", "lamp", "green orange lamp stand", "green orange lamp table", "", "the", "stand table lamp"]
    docs = [(i, t + "\nbody", "en" if i != 1 else "fr", "s") for i, t in enumerate([*titles, "Orange"])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    from pyspark.sql import functions as F

    k = {r[0]: (r[1], set(r[2])) for r in df.select("doc_id", "lang", X.tokens(F.substring_index("text", "\n", 1))).collect()}
    want = set()
    for a, b in combinations(sorted(k), 2):
        (la, x), (lb, y) = k[a], k[b]
        if la == lb and x and y and len(x & y) / len(x | y) >= texts.SIMILAR:
            want.add((a, b, int(len(x & y) / len(x | y) * 10000 + 0.5)))
    got = {tuple(r) for r in QUERIES["title_similarity"](spark, str(tmp_path)).collect()}
    assert got == want and (0, 9, 10000) in got


def test_copies_of_titles_are_compared_as_one(spark, tmp_path, monkeypatch):
    """Seven copies and what is alike to them, written out in blocks of two."""
    from itertools import combinations

    from tidewater.queries import texts

    monkeypatch.setattr(texts, "BLOCK", 2)
    docs = [(i, ("green orange lamp stand" if i < 7 else "lamp stand orange table") + f"\nbody {i}", "en", "s") for i in range(9)] + [(9, "green orange lamp stand", None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["title_similarity"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(a, b, 10000 if (a < 7) == (b < 7) else 6000) for a, b in combinations(range(9), 2)]
    sets = spark.createDataFrame([(1, "en", ["a", "b", "c"]), (2, "en", ["a", "b", "d"]), (3, "en", ["a", "x", "y"]), (4, "fr", ["a", "b", "c"])], "id long, lang string, k array<string>")
    assert [tuple(r) for r in texts.similar_sets(sets, 0.5).collect()] == [(1, 2, 5000)]


def test_shared_names_keep_their_digits(spark, tmp_path):
    docs = [(i, f"alpha.\nso Amber0 met, Bolt11 met, Coral222 met {i}.", "en", "s") for i in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["edges_same_actor"](spark, str(tmp_path)).collect()]
    assert got == [(0, 1, 76, "amber0, bolt11, coral222")]


def test_letters_beyond_the_first_plane_share_no_names(spark, tmp_path):
    docs = [(i, f"alpha.\nso \U0001d400Amber met, Bolt met, Coral met {i}.", "en", "s") for i in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["edges_same_actor"](spark, str(tmp_path)).collect()]
    assert got == [(0, 1, 64, "bolt, coral")]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(core.queries()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 30
