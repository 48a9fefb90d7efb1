import corpus_pipeline as cp
from pyspark.sql import functions as F

from conftest import SF
from pagemill.llm import bagminhash, packing, pii, substring_dedup, toxicity
from pagemill.llm.common import load
from pagemill.llm.queries import tokenizer


def test_stages(spark):
    """Each stage against what its operator says about the stage's own input."""
    docs = load(spark, SF, "documents")
    names = docs.columns
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        after = out.collect()
        if name != "packing":
            assert out.columns == names
            assert all(r["n_chars"] == len(r["text"]) for r in after if name in ("substring_dedup", "pii"))
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            score = {r["doc_id"]: r["score"] for r in toxicity.fit(docs, load(spark, SF, "labels")).score(docs).collect()}
            assert ids == {i for i in before if score[i] < 0.7}
        elif name == "near_duplicates":
            of = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()}
            assert ids == set(of.values()) and len(after) == len(ids)
        elif name == "substring_dedup":
            want = substring_dedup.brute_force([before[i]["text"] for i in sorted(before)])
            assert [len(r["text"].encode().split()) for r in sorted(after)] == [n - gone for n, gone, _ in want]
        elif name == "pii":
            assert ids == set(before) and not any(pii.detect(r["text"]) for r in after)
        else:
            assert ids == set(before)
            enc = packing.encoder(tokenizer("byte_bpe_50k.json"))
            n = {}
            for r in after:
                n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["length"]
            assert all(n[i] == len(enc.encode_ordinary(before[i]["text"])) + 1 for i in before)
        docs = out
    assert cp.run(spark, SF).count() == len(after)


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, nested columns and names that operators use: no row is lost, no other column changed."""
    passage = " ".join(f"w{i}" for i in range(60))
    x, y = (" ".join(f"{c}{i}" for i in range(90)) for c in "xy")
    data = [(1, None, "a"), (2, "", None), (None, "mail a@b.cc now", "x"), (4, f"{passage} {x}", None), (5, f"{y} {passage}", "b"), (6, "one text here", None), (6, "one text here", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, note string").withColumns({"n_chars": F.length("text").cast("long"), **{c: F.lit(f"extra {c}") for c in ("score", "kept", "_row1", "_n", "row", "node", "n_words", "hits", "evidence")}})
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("note")))
    for table in (docs, docs.where("1 = 0")):
        now = table
        for name, stage in cp.STAGES:
            before, now = now, stage(spark, now, SF)
            if name == "packing":
                continue
            assert now.columns == docs.columns
            rest = lambda df: sorted(str(r) for r in df.drop("text", "n_chars").collect())
            if name == "near_duplicates":
                assert rest(now) == sorted(set(rest(before)))
            else:
                assert rest(now) == rest(before)
        if table is docs:
            assert sorted(str(r["text"]) for r in before.collect()) == ["", "None", "mail <email> now", "one text here", x, y]
            assert sorted(str(r["doc_id"]) for r in now.collect()) == ["1", "2", "4", "5", "6", "None"]
        else:
            assert now.count() == 0
