"""Word queries over tokens of every length and seeds and shares of every length."""

import re

import pytest

from tracewell.operators.words import SHARE_GENERATORS
from tracewell.plans import traces
from tracewell.plans.evidence import RULE_WORDS, seed_phrase, viewed


@pytest.fixture
def made(spark, tmp_path):
    """A folder with a documents table of the texts."""

    def make(texts):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_typos_of_all_lengths_equal_brute_force(spark, made):
    some = RULE_WORDS[7]
    path = made([f"{some[:-1]} {some}xy {some}z qq", "extraordinary"])
    own = {w.decode() for r in viewed(spark, path).select("data").collect() for w in re.findall(rb"[a-z]+", bytes(r.data).lower())}
    want = {}
    for w in own - set(RULE_WORDS[:2048]):
        near = [(distance(w, c), c) for c in RULE_WORDS[:2048] if abs(len(w) - len(c)) <= 2 and 3 <= len(w) <= 10]
        near = [(d, c) for d, c in near if d <= 2]
        if near:
            want[w] = (len(near), min(near)[0], min(c for _, c in near))
    got = {r.word: (r.candidates, r.least_edits, r.first_candidate) for r in traces.typo_distance(spark, path).collect()}
    assert got == want and {3, 5, 6} <= {len(w) for w in got}


def share_of_33():
    """A share of 33 words: 30 data words and three checksum words."""
    data = [(1, 2, 0)[k] if k < 3 else (37 * k + 5) % 1024 for k in range(30)]
    c = 1
    for v in [*(b"shamir"), *data, 0, 0, 0]:
        top, c = c >> 20, (c & 0xFFFFF) << 10 ^ v
        for i, g in enumerate(SHARE_GENERATORS):
            c ^= g if top >> i & 1 else 0
    return data + [(c ^ 1) >> k & 1023 for k in (20, 10, 0)]


def test_words_of_all_lengths(spark, made):
    say = lambda ixs: " ".join(RULE_WORDS[i] for i in ixs)
    near = say(seed_phrase(bytes(range(40, 60)))).split()
    near[6] = "qq"
    path = made([say(share_of_33()) + " .", " ".join(["qq", *near, "qq ."]), say(seed_phrase(bytes(range(60, 80)))) + " ."])
    assert ("doc-0", "slip39-33") in {(r.target, r.needle) for r in traces.slip39_shares(spark, path).collect()}
    assert ("doc-1", "bip39-15-near-miss") in {(r.target, r.needle) for r in traces.near_misses(spark, path).collect()}
    # the view plants a share of 20 words or the like in other documents; these two hold a share and a seed of 15 words
    assert not {"doc-0", "doc-2"} & {r.target for r in traces.unordered_runs(spark, path).where("end - start > 70 and start = 0").collect()}
