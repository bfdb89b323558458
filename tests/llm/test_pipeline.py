"""The pipeline on a small planted table: what goes, what stays, and the packed ids of what stays."""

import os
import random
import re
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from resonant.llm import ngram_join, tokens, workers
from resonant.llm.scratch import _trim, memory_returned, settled, shared_dir

EN = "the shall which thing other would where there under again never through because people water little great house world still".split()


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(EN) + rng.choice(["", "", "ing", "ed", "ly"]) for _ in range(n))
    item, clean = prose(30), [prose(60) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows[3] = (3, clean[3] + "\nPage 1 of 7 in this long printed edition", "en", "s0", 0)
    rows += [(40 + i, prose(50) + f"\nPage {i} of 70 in this long printed edition", "en", "s1", 0) for i in range(6)]
    near = clean[5].split()
    near[30] = "changed"
    rows += [(60, clean[4], "en", "s1", 0), (61, " ".join(near), "en", "s1", 0), (62, f"{prose(20)} {item} {prose(20)}", "en", "s2", 0), (63, "12 34 5678", "en", "s2", 10), (64, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert kept == {*range(30), *range(40, 46)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in rows}
    texts |= {i: texts[i].split("\n")[0] for i in range(40, 46)}  # doc 3 is the first with that template and keeps it
    for i in kept:
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)])
        assert ids.tolist() == [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]


def test_long_lines_go_after_near_copies(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(EN) + rng.choice(["", "", "ing", "ed", "ly"]) for _ in range(n))
    passage, first, other = prose(51), [prose(30) for _ in range(6)], prose(30).split()
    near = [*first[:5], first[5].replace(first[5].split()[12], "changed", 1)]
    texts = ["\n".join(first), "\n".join(near), f"{prose(70)}\n{passage}", f"{' '.join(other)}\n{passage}"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(ids) == {0, 2, 3} and ids[3] == [*tokenizer.encode(" ".join(other), add_special_tokens=False).ids, 1]


def test_copies_that_long_lines_leave_go_and_packing_packs_all(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(EN) + rng.choice(["", "", "ing", "ed", "ly"]) for _ in range(n))
    one, two, rest = prose(60), prose(60), "\n".join(prose(12) for _ in range(3))
    texts = ["\n".join([*(prose(14) for _ in range(5)), one, two]), f"{rest}\n{one}", f"{rest}\n{two}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert left == {0: texts[0], 1: rest}  # 1 and 2 differ in their long lines alone, which 0 has
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.doc_tokens for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_intermediates_go_with_their_pass(spark, tmp_path):
    rng = random.Random(10)
    prose = lambda n: " ".join(rng.choice(EN) + rng.choice(["", "", "ing", "ed", "ly"]) for _ in range(n))
    passage, texts = prose(30), [prose(50) for _ in range(8)]
    docs = spark.createDataFrame([(i, f"{t}\n{passage}", "en", "s", 0) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = shared_dir(spark).removeprefix("file://")
    there = lambda: {n.rpartition("-")[0] + "/" + n for n in os.listdir(shared)}
    before = there()
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    new = sorted(n.split("/")[0] for n in there() - before)
    assert new.count("sets") == new.count("without-long-lines") == 1 and not {"without-copies", "line-templates", "dropped-lines"} & {*new}
    assert {r.doc_id: r.text for r in left.collect()} == {i: f"{t}\n{passage}" if i == 0 else t for i, t in enumerate(texts)}
    before = there()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(n.split("/")[0] for n in there() - before) == ["stage-packing"]
    assert {r.doc_id for r in got.collect()} == {*range(8)}


def test_the_driver_gives_back_memory_after_a_pass(spark):
    """The heap by a full collection, the C library's by a command, which must not fail unseen on this JVM."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    assert settled(spark, lambda: spark.range(3).toDF("x"), "three").count() == 3
    assert full() > before
    _trim(spark)


def test_executors_give_back_their_heaps(spark):
    """Here the driver's JVM is the only executor: it collects once as the driver, once in a task."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    memory_returned(spark)
    assert full() >= before + 2


def test_workers_give_back_what_tasks_have_freed(spark):
    anonymous = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    def run(batches):
        held = [np.ones(12_000) for _ in range(2000)]  # 190 MB, of blocks that the C library keeps under the last one
        kept.append(held.pop())
        yield len(held)

    kept = []
    tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    before = anonymous()
    assert list(workers.returning(run, encodes=True)([])) == [1999] and tokens.encoder.cache_info().currsize == 1
    assert anonymous() < before + 60
    list(workers.returning(run)([]))
    assert tokens.encoder.cache_info().currsize == 0  # an operator that does not encode has no use for it


def test_the_join_leaves_no_memory_in_its_workers(spark, monkeypatch, tmp_path):
    """Each of its tasks in Python gives back memory, of which executors had too much."""
    wrapped = []
    monkeypatch.setattr(ngram_join, "returning", lambda run, **how: wrapped.append(run.__qualname__.split(".")[0]) or workers.returning(run, **how))
    docs = spark.createDataFrame([(i, f"{i % 3} one two three four five six seven eight nine ten") for i in range(9)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {i: i % 3 for i in range(9)}
    assert {"_scan", "_tell", "_often", "_emit", "_lists", "_verify"} <= {*wrapped}
