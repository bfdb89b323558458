"""Each operator against brute force or an exact round trip, with nulls, empty and long texts, repeats and clashing columns."""

import os
import random
import re
import string
import textwrap
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resonant.llm import bytescan, decontam, ids, language_id, license_scan, line_templates, ngram_join, packing, registry, token_codec, tokens, unit_dedup, url_lists, vector_dedup
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(seed=0):
    """Ids and texts: copies, near copies, short, empty, null, long, unusual characters."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 6, 30, 120])) for _ in range(25)]
    out = [None, "", " \n\t ", "one", "Ünï cödé – 漢字 don't\x1cstop <|endoftext|>", prose(rng, 5000)] + base + base[:6]
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs_of()], "doc_id long, text string, block string, n long").repartition(3)


TEXT = st.text(alphabet=st.sampled_from(list("abAB'.,sStdΣσςİı̇éÉ×ß\x1c\x85 \n\t12#-漢<|>")), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_encoder_equals_the_library(texts):
    e = tokens.encoder(PATH)
    data, offsets = bytescan.text_buffer(pa.array(texts, pa.string()))
    ids, bounds = e.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**32 - 1)), max_size=700))
def test_words_round_trip(ids):
    ids = np.array(ids, np.uint32)
    words, first = token_codec.encode_words(ids)
    assert np.array_equal(token_codec.decode_words(words, first, len(ids)), ids)


def encoded():
    t = Tokenizer.from_file(PATH)
    return {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in docs_of()}


def test_shards(spark, docs):
    got = token_codec.encode_and_read(docs, PATH, 2).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("doc_id").collect()
    at = 0
    for r, (i, ids) in zip(got, sorted(encoded().items()), strict=True):
        raw = np.array([*ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.c) == (i, at, len(ids) + 1, zlib.crc32(raw))
        at += len(ids) + 1
    assert token_codec.encode_and_read(docs.limit(0), PATH).count() == 0
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").unionByName(docs.select("doc_id", "text"))
    assert token_codec.encode_and_read(odd, PATH).where("doc_id is null").count() == docs.count()


def test_packing(docs):
    rows = packing.pack_documents(docs, PATH, 1).collect()
    want = {i: [*ids, 1] for i, ids in encoded().items()}
    for i, ids in want.items():
        parts = sorted((r.start, r.length, r.ids) for r in rows if r.doc_id == i)
        assert b"".join(bytes(p[2]) for p in parts) == np.array(ids, "<u4").tobytes()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    for parts in by.values():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at <= parts[0][2] <= 2048
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=200))
def test_windows_hold_everything_once(sizes):
    windows = packing.fill(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)


def test_url_lists(spark):
    entries = spark.createDataFrame([("Example.com", "a", 10, True), ("example.com", "a", 20, False), ("b.example.com/x", "b", 5, True), (None, "c", 1, True), ("", "c", 1, True), ("http://www.z.org:80/", "c", 1, None)], "pattern string, category string, s long, active boolean").withColumn("since", F.timestamp_seconds("s"))
    rows = [(1, "http://sub.example.com/q", 15), (2, "http://example.com", 20), (3, "https://b.example.com:443/x/y?z", 30), (4, "http://b.example.com/xy", 30), (5, None, 15), (6, "http://z.org/", None), (7, "HTTP://Z.org/p", 2), (8, "http://notexample.com", 15), (1, "http://sub.example.com/q", 15)]
    captures = spark.createDataFrame(rows, "page_id long, url string, f long").select("page_id", "url", F.timestamp_seconds("f").alias("fetched_at"), F.lit(1).alias("blocked"), F.lit(2).alias("pattern"))
    got = sorted((r.page_id, r.blocked, r.matched_pattern) for r in url_lists.filter_urls(captures, entries).collect())
    assert got == sorted([(1, True, "example.com"), (1, True, "example.com"), (2, False, None), (3, True, "b.example.com/x"), (4, False, None), (5, False, None), (6, False, None), (7, True, "z.org"), (8, False, None)], key=lambda x: x[:2])
    assert not url_lists.filter_urls(captures, entries.limit(0)).where("blocked").count() and url_lists.filter_urls(captures.limit(0), entries).count() == 0


def test_line_templates(spark):
    rng = random.Random(3)
    own = [prose(rng, 12) for _ in range(8)]
    rows = [(i, f"{own[i]}\nOrder {i * 17} was sent to user{i}@x.org\n\nall of these words here stay the {WORDS[i]} same in every line") for i in range(8)] + [(20, None), (21, ""), (22, "\n\n"), (None, "Order 5 was sent to a@b")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df, 5).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    assert all(got[i].text == own[i] + "\n" and got[i].n_dropped == 2 for i in range(1, 8))
    assert got[20].text is None and got[21].text == "" and got[22].text == "\n\n" and got[None].n_dropped == 0
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0
    four = line_templates.drop_recurring_lines(df.where("doc_id < 4"), 5)
    assert four.where("n_dropped > 0").count() == 0


@pytest.mark.parametrize("places, length", [((7,), 14), ((5, 9), 14), ((4, 8), 20), ((2,), 5), ((0,), 12), ((0, 1), 12)])
def test_lines_that_vary_in_words(spark, places, length):
    """Varying words at any one or two places of a line that is otherwise the same; no digit marks them."""
    rng = random.Random(4)
    fixed = prose(rng, length).split()
    rows = []
    for i in range(10):
        w = list(fixed)
        for p in places:
            w[p] = WORDS[100 + 11 * i + p]
        rows.append((i, f"{prose(rng, 13)}\n{' '.join(w)}"))
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sum(r.n_dropped for r in got) == 9 and all(r.n_dropped == 0 or r.text == rows[r.doc_id][1].split("\n")[0] for r in got)


def test_unlike_lines_of_one_leaf_stay(spark):
    """Lines that agree in every third place alone are no template."""
    rng = random.Random(7)
    frame = [WORDS[j] if j % 3 == 0 else None for j in range(24)]
    rows = [(i, " ".join(w or rng.choice(WORDS) for w in frame)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(n).alias(n) for n in ("_d", "_t", "_drops", "d", "t", "drops", "row", "a.b")])
    got = line_templates.drop_recurring_lines(df, 5)
    assert got.columns[: len(df.columns)] == df.columns and got.where("n_dropped > 0").count() == 0
    assert all(tuple(r)[2:10] == tuple(df.columns[2:]) for r in got.collect())


def test_unlike_lines_of_one_leaf_are_parted_by_similarity(spark):
    """Two templates, each with two varying words, among lines that agree with them in every third place alone."""
    rng = random.Random(17)
    frame = [WORDS[j] if j % 3 == 0 else None for j in range(24)]
    fixed = [[w or rng.choice(WORDS) for w in frame] for _ in range(2)]
    rows = [(i, " ".join(w or rng.choice(WORDS) for w in frame)) for i in range(30)]
    for i in range(12):
        w = list(fixed[i % 2])
        w[1], w[5] = WORDS[40 + i], WORDS[70 + i]  # no tree leaves out the places of both, but the one of the frame
        rows.append((30 + i, "\n".join([prose(rng, 13), " ".join(w)])))
    few = [(60 + i, f"{prose(rng, 24)}") for i in range(4)]
    df = spark.createDataFrame([*rows, *few], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df, 5).collect()}
    assert {i for i, r in got.items() if r.n_dropped} == {*range(32, 42)}
    assert all(r.text == (dict(rows + few)[i].split("\n")[0] if 32 <= i < 42 else dict(rows + few)[i]) for i, r in got.items())
    assert line_templates.drop_recurring_lines(df, 7).where("n_dropped > 0").count() == 0


def test_tokens_of_unlike_lines_are_not_broadcast(spark):
    """Lines that repeat few tokens are a small file, but many rows of tokens."""
    rng = random.Random(18)
    rows = [(i, " ".join(WORDS[j] if j % 3 == 0 else rng.choice(WORDS[:40]) for j in range(24))) for i in range(60)]
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = runs.executionsList()
    plans = [made.apply(i).physicalPlanDescription() for i in range(before, made.size())]
    plans = [p for p in plans if "posexplode(w#" in p]
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_fields_are_told_at_once():
    """The faster pattern of fields stands for that of the SQL."""
    rng = random.Random(19)
    for _ in range(20_000):
        line = "".join(rng.choice("ab:/:/:/ \t7@é") for _ in range(rng.randrange(24)))
        assert re.sub(line_templates.FIELD_AT_ONCE, "<*>", line) == re.sub(line_templates.FIELD, "<*>", line), line


def test_a_long_token_beside_a_field_is_read_once(spark):
    """Of a token of 400,000 letters, the pattern was tried at each letter on all that follow."""
    rows = [(i, f"{'x' * 400_000} 7{i}\nown{WORDS[i]}") for i in range(6)]
    began = time.monotonic()
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {0: rows[0][1]} | {i: f"own{WORDS[i]}" for i in range(1, 6)} and time.monotonic() - began < 60


def test_long_lines_recur_from_two_documents_on(spark):
    rng = random.Random(6)
    passage, short, numbers = prose(rng, 51), prose(rng, 10), " ".join(f"{i}.5" for i in range(60))
    rows = [(i, f"{prose(rng, 9)}\n{passage} seen {i} times\n{short}\n{numbers}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df, 5, long_words=20).collect()}
    assert got[0].text == rows[0][1]
    for i in (1, 2):  # only the long line goes; a row of numbers has no words
        assert got[i].text == rows[i][1].replace(f"{passage} seen {i} times\n", "") and got[i].n_dropped == 1
    assert line_templates.drop_recurring_lines(df, 5).where("n_dropped > 0").count() == 0


def test_a_text_is_split_once_however_many_lines_stay(spark):
    rows = [(i, "\n".join(f"own{WORDS[j]} of {WORDS[i]}\nthis line is in all of them {WORDS[j]}" for j in range(40))) for i in range(6)]
    got = line_templates.drop_recurring_lines(spark.createDataFrame([*rows, (6, "\n\n"), (7, "")], "doc_id long, text string"), 5)
    for r in got.collect():
        own = rows[r.doc_id][1].split("\n")[::2] if r.doc_id < 6 else []
        assert r.n_lines == (80, 80, 80, 80, 80, 80, 3, 1)[r.doc_id] and (r.n_dropped in (0, 80) or r.text == "\n".join(own))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(body") == 1


def test_language(spark):
    rng = random.Random(5)
    vocab = {"en": ["the", "shall", "which", "thing", "other", "would"], "de": ["und", "nicht", "schön", "über", "zwischen", "auch"], "fr": ["être", "quelle", "français", "après", "aussi", "leur"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(20)), k, f"{k}.example.{k}") for i, k in enumerate(list(vocab) * 40)]
    held = [(1000 + i, " ".join(rng.choice(vocab[k]) for _ in range(15)), None, None, k) for i, k in enumerate(list(vocab) * 5)]
    odd = [(2000, None, "en", "a"), (2001, "", None, None), (2002, "12 34", "de", "a"), (2003, "qzx" * 200, None, None), (None, "the thing", "en", "a")]
    df = spark.createDataFrame(rows + [h[:4] for h in held] + odd, "doc_id long, text string, lang string, source string")
    training = spark.createDataFrame([(t, f"{k.upper()}-x") for _, t, k, _ in rows[:60]] + [(None, "en"), ("the", None)], "text string, label string")
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("label", F.lit(1)), training).collect()}
    assert all(got[h[0]].language == h[4] and got[h[0]].accepted for h in held)  # no declaration, no host
    assert all(got[r[0]].language == r[2] for r in rows)
    assert not any(got[i].accepted for i in (2000, 2001, 2002, 2003)) and got[None].accepted
    assert language_id.identify(df.limit(0), training).count() == 0
    assert {r.language for r in language_id.identify(df, training.limit(0)).collect()} == {"und"}


def posteriors_by_force(rows, training, alpha=20.0, dependence=0.2, trust=(0.9, 0.8), und=0.01):
    """(id, text, declared, host, suffix) to the probabilities of each language and und, one row and term at a time."""
    def buckets(text):
        raw = text.lower().encode()
        letter, digit = [97 <= b < 123 for b in raw], [48 <= b < 58 for b in raw]
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 17 for i in range(len(raw) - 2) if any(letter[i : i + 3]) and not any(digit[i : i + 3])]

    names = sorted({k for _, k in training})
    counts = {k: np.full(1 << 15, 0.05) for k in names}
    for t, k in training:
        for b in buckets(t):
            counts[k][b] += 1
    classes = [*names, "und"]

    def softmax(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    evidence = []
    for _, text, declared, _, suffix in rows:
        ll = [dependence * sum(np.log(counts[k][b] / counts[k].sum()) for b in buckets(text)) for k in names] + [-dependence * np.log(1 << 15) * len(buckets(text))]
        for told, t in ((declared, trust[0]), (suffix, trust[1])):
            if told in names:
                ll = [v + np.log(t if c == told else (1 - t) / (len(classes) - 1)) for v, c in zip(ll, classes)]
        evidence.append(ll)
    first = [softmax(ll) for ll in evidence]
    domain = lambda h: ".".join(h.split(".")[-2:]) if h else None
    floor = np.array([(1 - und) / len(names)] * len(names) + [und])
    smooth = lambda chosen, below: (sum(chosen, np.zeros(len(classes))) + alpha * below) / (len(chosen) + alpha)
    top = smooth(first, floor)
    out = {}
    for (i, _, _, host, _), ll in zip(rows, evidence):
        mid = smooth([p for p, r in zip(first, rows) if domain(r[3]) == domain(host)], top)
        own = smooth([p for p, r in zip(first, rows) if r[3] == host], mid)
        out[i] = dict(zip(classes, softmax(np.array(ll) + np.log(top if host is None else own))))
    return out


def test_language_posteriors_equal_brute_force(spark):
    rng = random.Random(8)
    words = {"en": ["the", "shall", "which", "thing"], "de": ["und", "nicht", "durch", "auch"], "fr": ["quelle", "aussi", "leur", "pour"]}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    training = [(say(k, 12), k) for k in words for _ in range(6)]
    hosts = ["a.example.de", "b.example.de", "www2.fr", "c.test.org", None]
    rows = []
    for i in range(60):
        k, host = rng.choice(list(words)), rng.choice(hosts)
        rows.append((i, say(k, rng.randrange(1, 3)) + rng.choice(["", " 12a3 xq"]), rng.choice([k, "de", None, "zz"]), host, host.split(".")[-1] if host else None))
    want = posteriors_by_force(rows, training)
    df = spark.createDataFrame([(i, t, f"{d}-XY" if d else None, f"https://{h}:80/x?y" if h else None) for i, t, d, h, _ in rows], "doc_id long, text string, lang string, source string")
    got = language_id.identify(df, spark.createDataFrame(training, "text string, label string")).collect()
    assert len(got) == 60
    for r in got:
        best = sorted(want[r.doc_id].items(), key=lambda x: (-x[1], x[0]))
        assert abs(best[0][1] - r.confidence) < 1e-9 and (best[0][0] == r.language or abs(best[0][1] - best[1][1]) < 1e-9)


def test_pages_as_evidence(spark):
    html = '<!DOCTYPE html><HTML class="x" LANG="fr-CA"><head><script>var lang="de";</script></head><body><!-- und nicht --><p>quelle &amp; aussi</p></body>'
    df = spark.createDataFrame([(1, "https://x.example.com/fr/1", html), (2, None, None)], "page_id long, url string, html string")
    one, two = language_id.of_pages(df).orderBy("page_id").collect()
    assert one.declared == "fr-CA" and one.text.split() == ["quelle", "aussi"] and two.text is None and two.declared is None


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_force(sets):
    ids = list(sets)
    low = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


@pytest.mark.parametrize("short", [24, 2])
def test_jaccard(spark, short):
    """A cluster of near copies larger than SHORT goes through the long lists."""
    rows = docs_of(1)
    rng = random.Random(9)
    seed = prose(rng, 80).split()
    for i in range(40):
        w = list(seed)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, component_id long").repartition(3)
    sets = {i: shingles(t) for i, t in rows}
    low = components_by_force(sets)
    got = ngram_join.jaccard_components(df, short=short).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), low[r.doc_id])


@pytest.mark.parametrize("short", [24, 1])
def test_jaccard_of_templates(spark, short):
    """Sets of frequent shingles in several components, near the threshold: bounds from the hub, cells of several parts."""
    rng = random.Random(3)
    blocks = [prose(rng, 14) for _ in range(9)]
    rows = []
    for i in range(140):
        chosen = [b for b in blocks if rng.random() < 0.75]
        rows.append((i, " ".join(chosen) + (f" {WORDS[i]}" if rng.random() < 0.3 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    low = components_by_force({i: shingles(t) for i, t in rows})
    assert len(set(low.values())) > 3
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, short=short).collect()} == low


def thue_morse(n):
    """Two texts of n letters, alike for every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_texts_alike_for_polynomial_hashes(spark):
    one, other = thue_morse(2048)
    assert len(np.unique(bytescan.span_hashes(*[np.frombuffer((one + other).encode(), np.uint8), np.array([0, 2048]), np.array([2048, 4096])]))) == 2
    e = tokens.encoder(PATH)
    ids, bounds = e.encode(*bytescan.text_buffer(pa.array([one, other, one])))
    for i, t in enumerate((one, other, one)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_join.jaccard_components(df).collect()) == [1, 2]
    vectors = [(i, [float(c == "a") for c in t[:64]] + [1.0]) for i, t in ((1, one), (2, other))]
    assert not any(r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect())
    item = " ".join([other, *WORDS[:9]])
    found = decontam.overlaps(spark.createDataFrame([(1, " ".join([one] * 10))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join([other] * 10)), (2, item)], "item_id long, text string"))
    assert found.count() == 0


def test_jaccard_edges(spark):
    """Equal ids with different texts are rows of their own, as are equal rows; a long text of one word."""
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "q r s t u v"), (9, "q r s t u v"), (8, "x" * 3_000_000), (8, "x" * 3_000_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())
    assert got == [(7, 2, 7), (7, 2, 7), (8, 1, 8), (8, 1, 8), (9, 2, 7)]
    rows = [(1, "a b c d e f"), (None, "a b c d e f")]
    many = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("hit"), F.lit(3).alias("k.0"))
    assert ngram_join.jaccard_components(many).count() == 2
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (None, None), (3, 3)], key=repr)
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_units(spark, unit):
    passage = "This passage of some length is found in more than one text."
    end = "\n\n" if unit == "paragraph" else "\n"
    rows = [(2, f"own two{end}{passage}{end}rest"), (1, f"{passage}{end}own one, which is long enough{end}"), (3, f"THIS passage, of some length is found in more than one text!{end}own three"), (4, None), (5, ""), (None, passage)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `removed.x` int")
    got = {r.doc_id: r for r in unit_dedup.drop_repeated_units(df, unit, min_words=12).collect()}
    assert got[1].text == rows[1][1] and got[2].text == f"own two{end}rest" and got[3].text == "own three" and got[None].text == passage
    for i in (2, 3):
        s = got[i].removed[0]
        original = dict(rows)[i]
        assert original[: s.start] + original[s.end :] == got[i].text and s.first_doc == 1 and got[i].n_removed == got[i].n_repeated == 1
    assert got[1].n_removed == 0 and got[1].n_repeated == 1
    assert got[4].text is None and got[5].text == "" and unit_dedup.drop_repeated_units(df.limit(0), unit).count() == 0


def repeats_by_force(rows, least):
    """Per document, the places of words in runs of ``least`` words that an earlier document holds."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        words = re.findall(r"[^\W_]+", t.lower())
        runs = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        out[i] = {p for k, r in enumerate(runs) if seen.get(r, i) < i for p in range(k, k + least)}
        for r in runs:
            seen.setdefault(r, i)
    return out


def test_units_catch_passages_and_leave_lone_sentences(spark):
    """Passages of 50 words in lines, across lines and within lines go; a short sentence that many documents hold stays."""
    rng = random.Random(5)
    sentence = lambda n: (prose(rng, n) + ".").capitalize()
    common = [sentence(9) for _ in range(4)]
    passages = [[sentence(rng.randrange(7, 14)) for _ in range(6)] for _ in range(8)]
    rows, planted = [], set()
    for i in range(160):
        lines = [" ".join(sentence(rng.randrange(5, 15)) for _ in range(3)) for _ in range(4)]
        lines.insert(2, rng.choice(common))
        if i % 3 == 0:
            p, kind = rng.choice(passages), i % 4
            planted.add(i)
            text = (" ", "\n", " ", "\r\n")[kind].join(p)
            at = rng.randrange(len(lines))
            lines[at] = f"{lines[at]} {text} {sentence(6)}" if kind == 2 else text if kind else f"{text}\n{lines[at]}"
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in unit_dedup.drop_repeated_units(df).collect()}
    force = repeats_by_force(rows, 50)
    later = {i for i, places in force.items() if places}
    assert later <= planted and len(later) > 30
    assert sum(got[i].n_removed > 0 for i in later) >= 0.9 * len(later)
    assert all(got[i].n_removed == 0 and got[i].text == t for i, t in rows if i not in planted)
    left = repeats_by_force([(i, r.text) for i, r in got.items()], 50)
    assert sum(map(len, left.values())) <= 0.1 * sum(map(len, force.values()))
    for i, t in rows:
        at, kept = 0, ""
        for s in got[i].removed:
            kept, at = kept + t[at : s.start], s.end
        assert kept + t[at:] == got[i].text


def test_units_at_hot_passages_overlaps_and_sizes(spark):
    """A passage of most documents, a text that repeats itself, a megabyte on one line, and repeated rows."""
    hot = " ".join(WORDS[:40]) + "."
    rows = [(i, f"{hot} {WORDS[i]} own") for i in range(300)] + [(900, "a b c d e f.\n" * 20), (901, "x. " * 200_000 + "." * 400_000)]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")
    got = unit_dedup.drop_repeated_units(df).orderBy("doc_id").collect()
    assert [r.n_removed for r in got[:301]] == [0, 0] + [1] * 299
    assert got[301].text == "a b c d e f.\n" and got[302].text.startswith("x. .")


def test_licenses(spark):
    rows = [(1, "x\nlicensed under the Apache License, version 2.0\nReleased under the MIT License."), (2, None), (3, ""), (4, "word"), (5, license_scan.TEMPLATES["MIT/grant"].upper()), (5, "Licensed work under some other licence")]
    got = sorted((r.doc_id, r.line, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, "Apache-2.0/notice"), (1, 2, "MIT/notice"), (5, 0, "MIT/grant")]


def test_license_tags_terms_and_defined_cases(spark):
    whole = ["MIT/grant", "MIT/condition", "MIT/warranty"]
    body = textwrap.fill(" ".join(license_scan.TEMPLATES[n] for n in whole), 76)
    rows = [(1, "// SPDX-License-Identifier: MIT"), (2, "# SPDX-License-Identifier: Apache-2.0"), (3, f"intro\n{body}\nend"), (3, f"intro\n{body}\nend"), (4, license_scan.TEMPLATES["GPL-2.0/terms"]), (5, license_scan.TEMPLATES["AGPL-3.0/terms"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(1).alias(n) for n in ("lines", "line", "known", "found", "a.b")])
    got = {}
    for r in license_scan.scan(df).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert got[1] == ["MIT/tag"] and got[2] == ["Apache-2.0/tag"] and sorted(got[3]) == sorted(whole * 2) and got[4] == ["GPL-2.0/terms"] and got[5] == ["AGPL-3.0/terms"]
    assert license_scan.scan(df.limit(0)).count() == 0
    assert license_scan.scan(df, {"one": "word", "none": ""}).count() == 0  # templates without a bigram match nothing
    assert license_scan.scan(spark.createDataFrame([(1, "word " * 200_000)], "doc_id long, text string")).count() == 0


def test_wrapped_and_commented_licenses(spark):
    t = license_scan.TEMPLATES
    grant = textwrap.wrap(t["MIT/grant"], 76)
    header = [f" * {x}" for x in textwrap.wrap(t["Apache-2.0/header"], 60)]
    own = "\n".join(["Copyright someone", "", *grant, "", "and so on"])
    comment = "\n".join(["/*", *header, " */", "int main() {}"])
    both = "\n".join(textwrap.wrap(t["GPL-3.0/terms"], 40) + ["", "words between them", ""] + textwrap.wrap(t["GPL-3.0/warranty"], 70))
    rows = [(1, own), (2, comment), (3, both), (4, f"{prose(random.Random(1), 30)} {t['MIT/grant']} {prose(random.Random(2), 40)}"), (5, "These words are not Released under the MIT License. They say so on one line."), (6, "\n".join(grant[:2])), (7, f"{own}\n{own}")]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append((r.line, r.license, r.content))
    assert got[1] == [(2, "MIT/grant", "\n".join(grant))] and 6 not in got
    assert (1, "Apache-2.0/header", "\n".join(header)) in got[2]
    assert [x[:2] for x in got[3]] == [(0, "GPL-3.0/terms"), (len(textwrap.wrap(t["GPL-3.0/terms"], 40)) + 3, "GPL-3.0/warranty")]
    assert got[4] == [(0, "MIT/grant", rows[3][1])] and got[5] == [(0, "MIT/notice", rows[4][1])]
    assert [x[:2] for x in got[7]] == [(2, "MIT/grant"), (2 + own.count("\n") + 1, "MIT/grant")]


def _notices(rng):
    """A text of edited notices, wrapped, commented, run together or repeated, among other words."""
    parts = []
    for _ in range(rng.randrange(1, 5)):
        words = license_scan.TEMPLATES[rng.choice(sorted(license_scan.TEMPLATES))].split()
        rate = rng.choice([0, 0, 0.03, 0.06, 0.12])
        words = [w for w in (rng.choice(["any", "such", w + " or"]) if rng.random() < rate else w for w in words) if rng.random() >= rate / 2]
        text = " ".join(words)
        if rng.random() < 0.7:
            text = textwrap.fill(text, rng.randrange(25, 90))
        if rng.random() < 0.3:
            text = "\n".join(f" * {x}" for x in text.split("\n"))
        parts += [prose(rng, rng.randrange(0, 15)), rng.choice(["\n", " ", "\n\n"]), text] + [text] * (rng.random() < 0.2)
    return rng.choice(["", "\n"]).join([*parts, rng.choice(["\n", " "]), prose(rng, rng.randrange(0, 15))])


def test_licenses_equal_sql_over_all_spans(spark):
    rng = random.Random(8)
    rows = [(i, _notices(rng)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "word"), rows[0], (0, rows[1][1]), (None, rows[2][1]), (204, "Released under the MIT\nLicense. " * 300)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])}))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("dice", F.round("dice", 6))
    assert got.where("content like '%\n%'").count() > 50
    assert compare(got, license_scan.ORACLE, con) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], duck(SF)) is None


def test_vectors_of_equal_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.05])]
    for kind in ("float", "double"):
        got = sorted(tuple(r) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect())
        assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_keeping_and_dropping_ids_with_any_column_names(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), *[F.lit(n).alias(n) for n in ("_p", "_hit", "_part", "_bits", "p", "hit", "bits", "row", "k", "i", "a.b")])
    gone = spark.createDataFrame([(3,), (3,), (4,), (None,), (99,)], "doc_id long")
    for f, n in ((ids.without, 48), (ids.only_needed, 2)):
        out = f(df, gone)
        assert out.columns == df.columns and out.count() == n and all(tuple(r)[1:] == tuple(df.columns[1:]) for r in out.collect())
    assert ids.without(df, gone.limit(0)).count() == 50 and ids.without(df.limit(0), gone).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(i, (base[i % 20] + rng.normal(size=8) * 0.2 * (i % 3)).tolist()) for i in range(200)] + [(900 + i, base[0].tolist()) for i in range(5)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [1.0] * 5), (2004, []), (None, base[0].tolist()), (2005, [1e300] * 8), (2006, [1e-300] * 8)]
    x = np.array([r[1] for r in rows] + [[1.0] * 8] * 2)
    ids = np.array([r[0] for r in rows] + [2005, 2006])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    low = ids.copy()
    while not np.array_equal(low, new := np.minimum(low, np.where(link, low[None], 1 << 60).min(1))):
        low = new
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")), tile=50).collect()}
    for i, n, c in zip(ids.tolist(), link.sum(1).tolist(), low.tolist()):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, i == c)
    assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, None))
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, 30)) for i in range(5)] + [(5, "just seven words are in this item"), (6, None), (7, "too short")]
    swapped = items[1][1].split()
    for k in (4, 13, 22):
        swapped[k] = "other"
    rows = [(1, f"{prose(rng, 40)} {items[0][1].upper()}! {prose(rng, 9)}"), (2, prose(rng, 20) + " " + " ".join(swapped)), (3, prose(rng, 400)), (4, None), (5, ""), (6, "before, just seven words are in this item. After"), (7, " ".join(items[2][1].split()[:8])), (8, "too short")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    for words in (40, 500_000):  # in several blocks, and in one
        got = {(r.doc_id, r.item_id): r for r in decontam.overlaps(df, spark.createDataFrame(items, "item_id long, text string"), block_words=words).collect()}
        assert set(got) == {(1, 0), (2, 1), (6, 5)}
        r = got[1, 0]
        assert rows[0][1].encode()[r.start_byte : r.end_byte].decode() == items[0][1].upper() and r.n_equal == 30
    assert decontam.overlaps(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.overlaps(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_masks_are_spaced_and_lose_no_accepted_stretch():
    """Every row but the last ignores a place within each mask; the hits stated are a lower bound for each placing of e other words."""
    assert all(set(range(mask[-1])) - set(mask) for row in decontam.MASKS[:-1] for mask in row)
    rng = random.Random(4)
    for length in (6, 8, 10, 13, 15, 17, 24):
        row, hits = decontam.seeds_for(length, 12, 0.8, 0.8)
        assert hits >= 1 and (length == 6) == (row > 0)
        for n in range(min(12, -(-length * 4 // 5)), length + 1):
            for e in (e for e in range(length - n + 1) if n >= 0.8 * (n + e)):
                for _ in range(50):
                    other = set(rng.sample(range(n + e), e))
                    assert hits <= sum(not other & {at + p for p in mask} for mask in decontam.MASKS[row] for at in range(n + e - mask[-1]))


def test_a_long_item_and_blocks_by_bytes(spark, monkeypatch):
    """An item of 30,000 words, found in a text that holds 40 of them; blocks that close by bytes find the same."""
    rng = random.Random(6)
    item = [f"x{rng.randrange(10**6)}" for _ in range(30_000)]
    docs = spark.createDataFrame([(1, "before " + " ".join(item[500:540]) + " after"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[510:530]))], "item_id long, text string")
    for limit in (decontam.BLOCK_BYTES, 10):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", limit)
        assert sorted((r.doc_id, r.item_id, r.n_equal) for r in decontam.overlaps(docs, items).collect()) == [(1, 1, 40), (1, 2, 20)]


def accepted_by_force(words, own, least=12, share=0.8, identity=0.8):
    """Whether verification accepts any alignment of the item with the document's words."""
    for begin in range(1 - len(own), len(words)):
        lo, hi = max(begin, 0), min(begin + len(own), len(words))
        equal = np.array(words[lo:hi]) == np.array(own[lo - begin : hi - begin])
        a, b = decontam.best_stretch(equal)
        n = int(equal[a:b].sum())
        if b > a and n >= min(least, np.ceil(share * len(own))) and n >= identity * (b - a):
            return True
    return False


def test_every_alignment_that_verification_accepts_is_found():
    """Items of 6 to 45 words with up to a fifth and more of their words substituted, and every fifth word substituted."""
    rng = random.Random(11)
    n_accepted = 0
    for length in (6, 7, 10, 11, 12, 15, 20, 33, 45):
        items = [prose(rng, length) for _ in range(25)]
        texts = []
        for k, item in enumerate(items):
            w = item.split()
            for p in range(4, length, 5) if k % 5 == 0 else rng.sample(range(length), rng.randint(0, length // 4 + 1)):
                w[p] = "other"
            texts.append(f"{prose(rng, 5)} {' '.join(w)} {prose(rng, 5)}")
        sent = type("Sent", (), {"value": decontam.Index(list(range(25)), [x.encode() for x in items])})
        batch = pa.RecordBatch.from_arrays([pa.array(range(25), pa.int64()), pa.array([x.encode() for x in texts], pa.binary())], names=["doc_id", "text"])
        got = {(r["doc_id"], r["item_id"]) for b in decontam._search(sent, 12, 0.8, 0.8)([batch]) for r in b.to_pylist()}
        want = {(d, i) for d in range(25) for i in range(25) if accepted_by_force(texts[d].split(), items[i].split())}
        assert got == want
        n_accepted += len(want)
    assert n_accepted > 100
