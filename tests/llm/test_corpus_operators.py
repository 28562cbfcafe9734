"""Near duplicates, substrings, neighbours, toxicity, chats and the pipeline against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracewell.llm import ann, chat, components, kernels, neardup, substrings, toxicity

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(t, width=5):
    w = words_of(lower(t))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(texts, ids):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and (ids[i] == ids[j] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sets, [None if d is None else least[top(i)] for i, d in enumerate(ids)]


def mutated(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), int(len(out) * share)):
        out[k] = rng.choice(WORDS) + "x"
    return " ".join(out)


def corpus(rng, n=12):
    texts = []
    for _ in range(n):
        own = rng.choices(WORDS, k=rng.randrange(8, 200))
        texts.append(" ".join(own))
        texts += [mutated(rng, own, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05, 0.08])) for _ in range(rng.randrange(6))]
    return texts


def test_near_duplicates_equal_brute_force(spark, docs, odd):
    rng = random.Random(11)
    texts = corpus(rng) + odd + ["One two THREE", "one two three", "one two three four five six"] + [" ".join(WORDS[:40])] * 5
    ids = rng.sample(range(1000), len(texts))
    sets, want = groups(texts, ids)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(texts, ids), block=16).collect()}
    assert len(got) == len(texts)
    for d, s, c in zip(ids, sets, want):
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(s), c, d == c)


def test_near_duplicates_of_one_large_group(spark, docs):
    """Copies around a base that mostly aren't like each other: blocks against blocks, and chains over members."""
    rng = random.Random(2)
    own = rng.choices(WORDS, k=120)
    texts = [mutated(rng, own, rng.choice([0.0, 0.02, 0.025, 0.03, 0.05])) for _ in range(160)]
    _, want = groups(texts, range(len(texts)))
    for block in (2048, 20):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(texts), block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_with_odd_ids(spark, docs):
    texts = ["a b c d e f", "a b c d e f", "other words stand in this one", None, "a b c d e f"]
    rows = neardup.near_duplicates(docs(texts, [3, None, 3, None, 9])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == sorted([("3", "3", True), ("None", "None", True), ("3", "3", True), ("None", "None", True), ("9", "3", False)])
    assert neardup.near_duplicates(docs([])).count() == 0


def thue_morse(n, a, b):
    return [a if bin(k).count("1") % 2 else b for k in range(n)]


def test_texts_made_to_collide_are_kept_apart(spark, docs):
    """Polynomial hashes modulo a power of two give the two sequences of a Thue-Morse word and its complement one hash."""
    one, two = ("".join(thue_morse(1024, *x)) for x in ("ab", "ba"))
    long = [" ".join(thue_morse(1024, *x)) for x in (("ab", "cd"), ("cd", "ab"))]
    texts = [" ".join([one] * 50), " ".join([two] * 50), " ".join(f"{one}{k}" for k in range(60)), " ".join(f"{two}{k}" for k in range(60))]
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(texts)).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 3: 3}
    texts += long
    got = substrings.remove_repeats(docs(texts), ["doc_id"], ["n_words", "n_removed", "kept_sha256"]).collect()
    assert sorted(map(tuple, got)) == sorted(removed(texts, range(len(texts)), 50))


def test_window_hashes_are_polynomials():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for which, base in enumerate(kernels.BASES):
        for width in (1, 2, 5, 25, 50):
            got = kernels.polynomials(word, width, which).tolist()
            assert got == [sum(int(word[i + j]) * pow(base, j, kernels.PRIME) for j in range(width)) % kernels.PRIME for i in range(301 - width)]
    x = np.array([0, 1, kernels.PRIME - 1, 2**60, 2**61 - 2], np.uint64)
    assert kernels.times(x, kernels.PRIME - 1).tolist() == [int(v) * (kernels.PRIME - 1) % kernels.PRIME for v in x]


def test_near_duplicates_without_the_signature_filter(spark, docs):
    rng = random.Random(17)
    texts = corpus(rng, 6)
    _, want = groups(texts, range(len(texts)))
    for agree in (0.0, 0.55):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(texts), block=4, agree=agree).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_sieves_never_lose_a_key(spark):
    from tracewell.llm.common import Sieve

    keys = spark.createDataFrame([(k,) for k in [*range(0, 5000, 7), -3, None]], "k long")
    rows = spark.createDataFrame([(k, str(k)) for k in [*range(5000), -3, None]], "k long, sieve_page string")
    rows = rows.withColumnRenamed("sieve_page", "v")
    got = {r.k: r.m for r in Sieve(keys, "k").marked(rows, "k", "m").collect()}
    assert len(got) == 5002 and all(got[k] for k in [*range(0, 5000, 7), -3]) and got[None] is False and sum(got.values()) < 760
    assert Sieve(keys.limit(0), "k").passing(rows, "k").count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(600, 640)] + [(7, 7), (None, 3), (640, 639), (1, 2), (2, 1)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in [500, *range(600, 641)]} == {500} and got[2] == got[1] == 1
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts, ids, width):
    """(words, removed, digest of the rest) by the definition."""
    first = {}
    split = [words_of(t) for t in texts]
    for d, w in zip(ids, split):
        for i in range(len(w) - width + 1) if d is not None else ():
            k = tuple(w[i : i + width])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in zip(ids, split):
        gone = set()
        for i in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [3, 8, 50])
def test_substrings_equal_brute_force(spark, docs, odd, width):
    rng = random.Random(width)
    passages = [rng.choices(WORDS, k=rng.choice([width - 1, width, width + 1, 70])) for _ in range(6)]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(rng.randrange(4)):
            own += rng.choices(WORDS, k=rng.randrange(30)) + rng.choice([[], *passages])
        texts.append(" ".join(own))
    texts += [texts[0], texts[3], *odd]
    ids = rng.sample(range(500), len(texts) - 2) + [None, None]
    rows = substrings.remove_repeats(docs(texts, ids), ["doc_id"], ["n_words", "n_removed", "kept_sha256"], width).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted([tuple(r) for r in rows], key=key) == sorted(removed(texts, ids, width), key=key)


def test_substrings_with_repeated_ids_and_none(spark, docs):
    own = " ".join(WORDS[:60])
    texts, ids = [own, own + " more", own], [4, 4, 9]
    rows = substrings.remove_repeats(docs(texts, ids), ["doc_id"], ["n_words", "n_removed", "kept_sha256"]).collect()
    assert sorted(tuple(r) for r in rows) == sorted(removed(texts, ids, 50))
    assert substrings.remove_repeats(docs([]), ["doc_id"], ["n_words"]).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 24)).astype(np.float32)
    v[300:420] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (None, [1.0] * 24), (905, [1.0] * 5), (920, [2.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = ann.search(table, table.vec_id % 20 == 0, block=256, query_block=16).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 900, 20):
        s = np.zeros(900)
        for k in range(24):
            s += v[q, k].astype(float) * v[:, k].astype(float)
        want = [int(i) for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert len(set(x for x, _ in by[q]) & set(want)) >= 19
        assert all(abs(s[x] - y) == 0 for x, y in by[q])
    assert by[920] == [(905, 10.0)] and 900 not in by and 902 not in by
    assert ann.search(table.limit(0), table.vec_id % 20 == 0).count() == 0


def string_kernel(s, t, n=3, decay=0.5):
    """By the definition: all pairs of equal subsequences, weighed by the letters they span."""
    from itertools import combinations

    def spans(x):
        out = {}
        for at in combinations(range(len(x)), n):
            k = tuple(x[i] for i in at)
            out.setdefault(k, []).append(decay ** (at[-1] - at[0] + 1))
        return {k: sum(v) for k, v in out.items()}

    a, b = spans(s), spans(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_kernel_equals_definition():
    rng = random.Random(6)
    pairs = [("".join(rng.choices("abcd", k=rng.randrange(3, 10))), "".join(rng.choices("abcd", k=rng.randrange(3, 8)))) for _ in range(60)]
    s, t = toxicity.codes([a for a, _ in pairs], 10), toxicity.codes([b for _, b in pairs], 8)
    t[t == -1] = -2
    assert np.allclose(toxicity.kernel(s, t), [string_kernel(a, b) for a, b in pairs], rtol=1e-4)


def test_reachable_equals_longest_common_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b, 1):
            out.append(max(row[j], out[-1], row[j - 1] + (x == y)))
        return out

    rng = random.Random(3)
    words = ["".join(rng.choices("abcde", k=rng.randrange(3, 12))) for _ in range(80)]
    marks = ["".join(rng.choices("abcde", k=rng.randrange(4, 8))) for _ in range(10)]
    got = toxicity.reachable(toxicity.codes(words, 12), marks)
    assert got.tolist() == [[lcs(w, m) >= len(m) - 1 for m in marks] for w in words]


def labelled_texts(rng, n=240):
    texts, toxic = [], []
    for k in range(n):
        own = rng.choices(WORDS, k=rng.randrange(10, 80))
        if k % 4 == 0:
            for _ in range(2):
                own.insert(rng.randrange(len(own)), rng.choice(["villain", "scoundrel", "bastler" + rng.choice(WORDS)]))
        texts.append(" ".join(own))
        toxic.append(int(k % 4 == 0))
    return texts, toxic


def test_toxicity_held_out_and_odd(spark, docs, odd):
    rng = random.Random(1)
    texts, toxic = labelled_texts(rng)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(texts), labels)
    new = ["some VIL-LAIN said", "a v i l l a i n said", "the villlain said", "bastlerxyz is here", " ".join(WORDS[:50]), *odd]
    got = {r.doc_id: r for r in toxicity.score(docs(texts + new), model).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and all(got[i].predicted == toxic[i] for i in held)
    n = len(texts)
    assert [got[n + k].predicted for k in range(5)] == [1, 1, 1, 1, 0]
    assert all(got[n + 5 + k].predicted == 0 for k in range(len(odd))) and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].sign == "x"
    one = toxicity.fit(docs(texts), labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs(["a"]), one).collect()} == {0}
    assert toxicity.score(docs([]), model).count() == 0


def test_equal_texts_score_alike_whatever_stands_beside_them(spark, docs):
    rng = random.Random(9)
    texts, toxic = labelled_texts(rng)
    table = docs(texts * 3)
    labels = spark.createDataFrame(list(enumerate(toxic)) + [(5, 0), (5, 1), (6, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(texts), labels)
    again = toxicity.fit(docs(texts).repartition(3), labels.repartition(5))
    assert model.landmarks == again.landmarks and (model.weights == again.weights).all() and (model.bias, model.slope, model.shift) == (again.bias, again.slope, again.shift)
    got = []
    for n in (1, 3, 11):
        toxicity.kernels._kept.clear()
        got.append({r.doc_id: r.score for r in toxicity.score(table.repartition(n), model).collect()})
    assert got[0] == got[1] == got[2]
    assert all(got[0][i] == got[0][i + len(texts)] for i in range(len(texts)))


def slow_scores(model, texts):
    """A text's score from string kernels, pooled over its words one by one."""
    out = []
    for text in texts:
        chunks = (text or "").encode().split()
        words = [w for w in map(toxicity.plain, chunks) if len(w) >= 3]
        vectors = []
        for w in words:
            own = []
            for m, k in zip(model.landmarks, model.own):
                lcs = [[0] * (len(m) + 1) for _ in range(len(w) + 2)]
                for i, x in enumerate("^" + w, 1):
                    for j, y in enumerate(m, 1):
                        lcs[i][j] = lcs[i - 1][j - 1] + 1 if x == y else max(lcs[i - 1][j], lcs[i][j - 1])
                v = string_kernel("^" + w, m) / float(k) if lcs[len(w) + 1][len(m)] >= len(m) - 1 else 0.0
                own.append(min(v, 1.0) if v >= toxicity.FAINT else 0.0)
            vectors.append(own)
        v = np.array(vectors or [[0.0] * len(model.landmarks)])
        most = v.max(0)
        x = np.concatenate([most, np.minimum(toxicity.PER * v.sum(0) / (len(chunks) + toxicity.PER), 3), [most[: model.bad].max(), min(most[: model.bad].sum(), 3)]])
        if not v.any():
            x[:] = 0
        out.append(1 / (1 + np.exp(-(model.slope * (x @ model.weights + model.bias) + model.shift))))
    return out


def test_scores_equal_the_definition(spark, docs, odd):
    rng = random.Random(1)
    texts, toxic = labelled_texts(rng)
    model = toxicity.fit(docs(texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    some = texts[:40] + ["some VIL-LAIN said", "the villlain said", "vllain vilain", "", None]
    got = {r.doc_id: r.score for r in toxicity.score(docs(some), model).collect()}
    assert np.allclose([got[i] for i in range(len(some))], slow_scores(model, some), atol=1e-4)


def test_chats_are_reversible(spark):
    evil = [chat.INJECTION, "&lt;|im_sep|>", "&amp;<|", "a\n<|im_sep|>b", "", None, "<", "|im_end|>", "é🎉"]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "tool<|im_end|>\nx", None]), rng.choice(evil)) for c in [1, 2, 3, None] for t in range(9)]
    rows += [(1, 3, "user", "again"), (1, 3, "user", "again"), (4, None, "assistant", "x")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    from pyspark.sql import functions as F

    out = chat.format_chats(table)
    read = out.select("conv_id", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    esc = lambda x: (x or "").replace("&", "&amp;").replace("<|", "&lt;|")
    for r in read:
        own = sorted([x[1:] for x in rows if x[0] == r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, esc(x[1]).replace("\n", "&nl;"), esc(x[2])))
        assert [tuple(x) for x in r.t] == [(a or "", b or "") for _, a, b in own]
        assert r.l == "".join(b or "" for _, a, b in own if a == "assistant")
    assert chat.format_chats(table.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    """100,000 turns in one conversation, in runs of one role and alternating."""
    from pyspark.sql import functions as F

    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when((F.col("id") % 3 == 0) | (F.col("id") > 90_000), "assistant").otherwise("user").alias("role"), F.concat(F.lit("t&"), F.col("id").cast("string")).alias("text"))
    out = chat.format_chats(rows)
    got = out.select(F.size(chat.turns_of(F.col("formatted"))).alias("n"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"), F.size("loss_spans").alias("s")).first()
    own = [k for k in range(n) if k % 3 == 0 or k > 90_000]
    assert got.n == n and got.s == len(own) and got.l == "".join(f"t&{k}" for k in own)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(5)
    texts, toxic = labelled_texts(rng, 120)
    clean = [i for i, t in enumerate(toxic) if not t]
    shared = " ".join(rng.choices(WORDS, k=60))
    long = [rng.choices(WORDS, k=150) for _ in range(4)]
    extra = [mutated(rng, long[0], 0.01), " ".join(long[0]), " ".join(long[1]) + " " + shared, " ".join(long[2]) + " " + shared, "key token=abcdef123456 " + " ".join(long[3]), None]
    all_texts, n = texts + extra, len(texts)
    docs(all_texts, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        assert step.columns == pipeline.COLUMNS
    kept = {r.doc_id: r for r in step.collect()}
    assert all(i in kept for i in clean) and not any(i in kept for i, t in enumerate(toxic) if t)
    assert n in kept and n + 1 not in kept and kept[n + 2].text == all_texts[n + 2]
    assert kept[n + 3].text == " ".join(long[2]) and kept[n + 3].n_chars == len(kept[n + 3].text)
    assert kept[n + 4].text.startswith("key [SECRET] ") and kept[n + 5].text is None
    pieces = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(kept)


def test_pipeline_of_odd_rows_and_of_none(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    same = " ".join(WORDS[:80])
    texts, ids = [None, "", same, same, same, "word", None, same + " x"], [1, 2, 9, 4, None, 9, None, 4]
    for name, rows in (("odd", docs(texts, ids, extra=False)), ("none", docs([], extra=False))):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
        pieces = pipeline.run(spark, str(folder)).toPandas()
        # 9 repeats 4 by one of its rows and goes with both; what has no id stays as it is
        assert sorted(map(str, pieces.doc_id.astype("Int64"))) == (["1", "2", "4", "4", "<NA>", "<NA>"] if name == "odd" else [])


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from tracewell.llm import common

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
