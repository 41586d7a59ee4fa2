"""Bounded history and kept summaries against direct models."""

import random

from pyspark.sql import functions as F

from quarry.plans import history as h
from quarry.sources.ledger import Ledger

KIND = "session_id long, position long, user_message string, ai_response string"


def model(rows, keep, most):
    """session -> (older pairs, end of their transcript), from whole sessions."""
    out = {}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        lines = [f"{who}: {t.strip(' ')}" for r in mine[: max(0, len(mine) - keep)] for who, t in (("User", r[2]), ("Assistant", r[3])) if t and t.strip(" ")]
        if len(mine) > keep:
            out[s] = (len(mine) - keep, "\n".join(lines)[-most:])
    return out


def test_ends_of_older_pairs(spark):
    draw = random.Random(5)
    text = lambda: draw.choice([None, "", "  ", "é" * draw.randint(1, 9), " two words ", "x" * 90])
    rows = [(s, p, text(), text()) for s in range(12) for p in draw.sample(range(10_000), draw.choice([1, 3, 7, 400]))]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    for keep, most in ((6, 50), (1, 1), (0, 120), (6, 100), (2, 100_000)):
        got = {r["session_id"]: (r["older"], r["transcript"]) for r in h.older_ends(df, keep, most).collect()}
        assert got == model(rows, keep, most), (keep, most)
    assert h.older_ends(df.limit(0)).count() == 0


def test_a_long_session_leaves_few_rows_to_gather(spark):
    """Of 200,000 pairs only those go on that can reach into the last letters."""
    pairs = spark.range(200_000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("position"), F.concat(F.lit("question "), "id").alias("user_message"), F.lit("answer").alias("ai_response"))
    row = h.older_ends(pairs).first()
    assert row["older"] == 199_994 and len(row["transcript"]) == 4_000 and row["transcript"].endswith("User: question 199993\nAssistant: answer")
    assert row["transcript"] == "\n".join(f"User: question {i}\nAssistant: answer" for i in range(199_800, 199_994))[-4_000:]


def test_ties_blanks_and_repeats(spark):
    rows = [(1, 5, f"q{k}", "a") for k in range(9)] + [(1, 5, "q0", "a")] + [(2, p, " ", None) for p in range(9)] + [(None, p, f"n{p}", "a") for p in range(8)]
    df = spark.createDataFrame(rows, KIND)
    first, again = (h.history(df.repartition(n)).orderBy("session_id", "position", "role", "content").collect() for n in (1, 7))
    assert first == again  # ties do not depend on how rows arrive
    notes = {r["session_id"]: r["content"] for r in first if r["role"] == "system"}
    assert set(notes) == {1, None} and notes[None] == "Earlier: User: n0\nAssistant: a\nUser: n1\nAssistant: a"  # nothing was said in the second
    said = [r["content"] for r in first if r["session_id"] == 1 and r["role"] == "user"] + notes[1].split("User: ")[1:]
    assert sorted(x.split("\n")[0] for x in said) == sorted(r[2] for r in rows if r[0] == 1)  # each pair is told once, old or recent


def test_summaries_are_made_once(spark, tmp_path):
    pairs = lambda *n: spark.createDataFrame([(s, p, f"q{s}.{p}", "a") for s, m in n for p in range(m)], KIND)
    cache = lambda: h.Summaries(Ledger(spark, str(tmp_path / "l")), most=3)
    by = lambda who: (lambda t: F.concat(F.lit(f"{who} "), F.length(t)))

    def notes(df, who, c):
        return {r["session_id"]: r["content"].split()[0] for r in h.history(df, summarise=by(who), cache=c).filter("role = 'system'").collect()}

    assert notes(pairs((1, 8), (2, 9), (3, 6)), "one", cache()) == {1: "one", 2: "one"}
    assert notes(pairs((1, 8), (2, 10)), "two", cache()) == {1: "one", 2: "two"}  # a new process; only what has grown is summarised again
    assert notes(pairs((4, 8), (5, 8)), "three", cache()) == {4: "three", 5: "three"}  # 2 was used before these, 1 at the same time: 1 goes
    assert notes(pairs((2, 10)), "four", cache()) == {2: "two"}
    assert notes(pairs((1, 8)), "five", cache()) == {1: "five"}
    assert notes(pairs((4, 8)), "six", cache()) == {4: "six"}  # went when 1 came back
    assert sorted(r["session_id"] for r in cache().ledger.snapshot().table("summaries").collect()) == [1, 2, 4]
    version = cache().ledger.snapshot().version
    assert notes(pairs((9, 2)), "x", cache()) == {} and cache().ledger.snapshot().version == version
    plain = h.history(pairs((1, 9), (2, 7)), cache=cache()).orderBy("session_id", "position").collect()
    assert [r for r in plain if r["role"] != "system"] == h.history(pairs((1, 9), (2, 7))).filter("role <> 'system'").orderBy("session_id", "position").collect()
    assert notes(spark.createDataFrame([(None, p, "q", "a") for p in range(8)], KIND), "y", cache()) == {None: "y"}  # a session without an id is never kept
