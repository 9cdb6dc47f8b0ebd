"""Line dedup: sketches lose no similar pair, and lines of one template are not compared in pairs."""

import random

from pyspark.sql import functions as F

from sparrowdoc.llm import lines


def shingles(t):
    return {t[i : i + 12] for i in range(max(1, len(t) - 11))}


def test_sketches_reject_no_similar_pair_and_most_others(spark):
    r = random.Random(4)
    texts = []
    for n in (1, 11, 12, 13, 60, 200, 500, 900, 3000):
        for _ in range(3):
            base = [r.choice("abcdefgh ij é") for _ in range(n)]
            texts.append("".join(base))
            for share in (0.005, 0.02, 0.03, 0.06, 0.2):
                other = list(base)
                for _ in range(round(n * share)):
                    other[r.randrange(n)] = "z"
                texts.append("".join(other))
    texts += ["a" * 40, "a" * 400, "ab" * 300, "ab" * 30]  # repeated shingles are one
    sketched = lines.sketches(spark.createDataFrame(list(enumerate(texts)), "node long, line string")).localCheckpoint()
    sets = [shingles(t) for t in texts]
    assert {x.node: x["size"] for x in sketched.collect()} == {i: len(s) for i, s in enumerate(sets)}
    pairs = lines._side(sketched, "a", "x").crossJoin(lines._side(sketched, "b", "y")).where("a < b")
    within = {(x.a, x.b) for x in pairs.where(lines._within("x", "y", 0.75)).select("a", "b").collect()}
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(texts)) for i in range(j)}
    similar = {p for p, v in like.items() if v >= 0.75}
    assert len(similar) > 50 and similar <= within
    assert not [p for p in within if like[p] < 0.6 and len(texts[p[0]]) in range(12, 901)]


def test_lines_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    """All lines agree in some band, none are 0.75 alike: texts are read for a few pairs only, not for each two lines."""
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    template, n = say(30), 120
    texts = [f"{template} {say(12)}" for _ in range(n)]
    compared, materialize = [], lines.materialize

    def counted(df, name):
        out = materialize(df, name)
        if name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lines.dedup(docs).agg(F.sum("n_removed")).first()[0] == 0
    assert sum(compared) <= n, compared


def chain(n):
    """Lines of which each is like its neighbours, and the last not like the first."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n + 40)]
    return [" ".join(words[i : i + 40]) for i in range(n)]


def test_bands_are_dealt_out_once(spark, monkeypatch):
    """The join's side had a column that the aggregate's had not, so Spark dealt all bands out twice."""
    plans, materialize = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if name == "met" else None) or materialize(df, name))
    docs = spark.createDataFrame(list(enumerate(chain(20))), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert lines.dedup(docs).agg(F.sum("n_removed")).first()[0] == 19
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plans[0].count("- Exchange hashpartitioning(band") == 1 and "ReusedExchange" in plans[0], plans[0]


def test_links_are_joined_to_what_was_joined_before(spark, monkeypatch):
    """Each of the three times all links were joined from the first on, in as many rounds."""
    from sparrowdoc.llm import components

    rounds, joins, materialize = [], lines.components, components.materialize
    monkeypatch.setattr(lines, "components", lambda links: rounds.append(0) or joins(links))

    def counted(df, name):
        rounds[-1] += name == "edges"
        return materialize(df, name)

    monkeypatch.setattr(components, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(chain(40))), "doc_id long, text string")
    assert lines.dedup(docs).agg(F.sum("n_removed")).first()[0] == 39
    assert rounds[0] > 3 and max(rounds[1:]) < rounds[0], rounds
