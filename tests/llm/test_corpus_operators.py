"""The dedup, search and screening operators against brute force."""

from __future__ import annotations

import gc
import hashlib
import random
import sys
import weakref
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from relayloom.llm import decontaminate, fingerprints, lines, near, pii, repeats, sketch, toxicity, warc  # noqa: E402
from relayloom.llm.common import scratch  # noqa: E402
from relayloom.llm.wordhash import window_minima, windows, words  # noqa: E402

DOCS = brute.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """The documents, with further columns whose names the operators use inside."""
    rows = [(i, t, "x", i, i, "y") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines long, bucket long, row string").repartition(3)


def test_line_dedup(docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(docs, n_batches=4, fan=2).collect()}
    want = brute.lines(DOCS)
    assert got == want and sum(x[1] for x in want.values()) > 5


def test_substring_dedup(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(docs).collect()}
    want = brute.repeats(DOCS)
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_substring_dedup_over_three_levels(docs):
    assert repeats.levels(50) == [13, 25, 50]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(docs, window=50).collect()}
    assert got == brute.repeats(DOCS, 50)


def test_near_dedup(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(docs).collect()}
    want = brute.near(DOCS)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 5
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_decontamination(spark, docs):
    texts = [t for _, t in DOCS if t and len(t.split()) > 20]
    items = [(1, " ".join(texts[0].split()[3:16])), (2, texts[4].upper()), (3, "two, words!"), (4, ""), (5, None), (6, "nobody says this at all in any document ever written"), (7, texts[0].split()[5]), (8, " ".join(texts[9].split()[:7]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, table).collect()}
    want = brute.contaminated(DOCS, items)
    assert got == want and any(x[1] for x in want.values())
    clean = decontaminate.drop_contaminated(docs, table)
    assert {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[1]} and clean.columns == docs.columns
    assert not any(r.contaminated for r in decontaminate.contamination(docs, table.where("false")).collect())


def _shuffled(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_decontamination_by_a_large_benchmark(spark, monkeypatch):
    """Without a broadcast the rows are the same and a text isn't sent along with its fingerprints."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"{x:05x}" for x in rng.integers(0, 1 << 20, n))
    texts = [say(n) for n in (20_000, 5000, *[400] * 60)]
    rows = list(enumerate(texts)) + [(100 + i, texts[1]) for i in range(40)] + [(200, None), (201, "")]
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    items = [(i, f"{say(3)} {cut(t, 7 * i, 12)} {say(3)}") for i, t in enumerate(texts[:20])] + [(70, cut(texts[30], 5, 4)), (71, say(40)), (72, texts[2])]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = _shuffled(spark)
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(docs, table).collect()}
        sent = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute.contaminated(rows, items)
    assert 0 < sent < 4 * sum(len(t or "") for _, t in rows)


TEXTS = [
    "mail a.b@c-d.org,x@y.z.w or a@b", "1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.02.3.255 and 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 42 4111111111111112", "+1 (754) 555-3087 and +49 30 123 and +1.2.3.4.5.6.7.8.9",
    "é@b.co üa@b.co\U0001f600 c@d.ee", "a@b.c_x@d.e..f@g.h", "", None, "9" * 400, "+" * 50, "x" * 5000 + "@", ("a@b.cc " * 3000), "0 0 0 0 0 0 0 0 0 0 0 0",
]


def test_pii_base_spans(spark):
    rows = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for i, t in enumerate(TEXTS):
        assert [(s.kind, s.start, s.end) for s in rows[i].base] == brute.personal(t or ""), t


def test_pii_terms(spark):
    say = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "kappa"]
    rows = [(i, f"{say[i]} Zanzibar wrote to boss@corp.com from {say[-1 - i]}") for i in range(8)] + [(100 + i, f"{say[i % 8]} wrote nothing to {say[i % 5]} number {i}") for i in range(200)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {s.text for s in got[0].spans if s.kind == "term"} == {"Zanzibar", "from"}
    assert "Zanzibar" not in got[0].sanitised and "[EMAIL]" in got[0].sanitised and got[100].sanitised == rows[8][1]
    copies = [(i, "alpha Zanzibar wrote to boss@corp.com from omega") for i in range(8)]
    assert not [s for r in pii.sanitise(spark.createDataFrame(copies, "doc_id long, text string")).collect() for s in r.spans if s.kind == "term"]


def test_warc_round_trip(spark):
    same, big = "x" * 1000, "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 9000
    html = [None, "", "a\r\n\r\nb", same, same, "y" * 999, "y" * 999, big, big, "z" * 4096, "é" * 70_000, "\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", t, "r") for i, t in enumerate(html)], "page_id long, url string, html string, record string").repartition(3)
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    for i, t in enumerate(html):
        raw = (t or "").encode()
        to = max(j for j, x in enumerate(html) if (x or "") == (t or "")) if len(raw) >= 1000 else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "response" if to == i else "revisit", None if to == i else to)
    path = scratch(spark, "warc")
    warc.write_archives(pages, path)
    assert {r.page_id: r.payload for r in warc.read_archives(spark, path, True).where("record_type = 'response'").collect()}[8] == big.encode()
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_warc_reader_notices_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [r["block"] for r in warc.parse(record * 2)] == [b"hello"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-6]))


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(docs, blocks=7).collect()}
    rows = sorted(DOCS, reverse=True, key=lambda x: x[0])
    near_sets = brute.sets
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edit))
        s = near_sets([(0, t), (1, edit), (2, nxt)])
        for j, value in ((1, r.near_edited), (2, r.near_next)):
            want = len(s[0] & s[j]) / len(s[0] | s[j]) if s[0] | s[j] else 1.0
            assert abs(value - want) < 0.1
    by_text = {}
    for i, t in DOCS:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert fingerprints.neighbour_fingerprints(docs.where("false")).count() == 0 and fingerprints.neighbour_fingerprints(docs.where(f"doc_id = {DOCS[0][0]}")).count() == 1


def test_toxicity(spark):
    rows, labels = [], []
    for i, t in brute.corpus(5, 600):
        bad = i % 4 == 0
        rows.append((i, f"{t or ''} idiots and morons {i}" if bad else t))
        labels.append((i, int(bad)))
    rows += [(100_000, "some 1d10ts and m0r0ns said so"), (100_001, "you i d i o t s there"), (100_002, None), (100_003, "iiidiots!!!"), (100_004, "what id iots they are"), (100_005, "such m o rons as these"), (None, "idiots and morons"), (None, None), (100_006, "")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect() if r.doc_id is not None}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.predicted, t) for i, t in labels if (r := got[i]).held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert [got[100_000 + i].predicted for i in range(7)] == [1, 1, 0, 1, 1, 1, 0]
    kept = toxicity.drop_toxic(d, lab)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows if t != "idiots and morons" and (i is None or not got[i].predicted))
    assert toxicity.toxicity(d, lab.where("false")).where("predicted = 1").count() == 0


def test_disguises_are_decoded():
    count = np.zeros(toxicity.SIZE**3)
    c = toxicity.classes("\n".join(["", *["idiot", "stupid", "shit", "clown", "crass", "good day"] * 50, ""]))
    np.add.at(count, c[:-2] * toxicity.SIZE**2 + c[1:-1] * toxicity.SIZE + c[2:], 1)
    three = count.reshape(toxicity.SIZE, toxicity.SIZE, toxicity.SIZE)
    restore = toxicity.Restorer(np.log((three + 0.01) / (three.sum(axis=2, keepdims=True) + 0.64)))
    for disguised, word in [("1d107", "idiot"), ("5h17", "shit"), ("sh!+", "shit"), ("h!+", "hit"), ("cra$$", "crass"), ("iidiott", "idiot"), ("stuupid", "stupid"), ("(lown", "clown"), ("(lown)", "clown"), ("good", "good")]:
        assert word in restore.word(disguised), disguised


def test_toxicity_decodes_only_what_can_weigh(monkeypatch):
    """Scores are those of decoding every token, while tokens that can't matter are not decoded; nothing of a scorer waits for a collection."""
    size, rng = toxicity.SIZE, random.Random(7)
    words = ["idiot", "moron", "loser", "stupid", "scum", "shit", "bookkeeper", "ciónel"]
    count = np.zeros(size**3)
    c = toxicity.classes("\n".join(["", *[*words, "good", "day", "letter"] * 50, ""]))
    np.add.at(count, c[:-2] * size**2 + c[1:-1] * size + c[2:], 1)
    three = count.reshape(size, size, size)
    characters = np.log((three + 0.01) / (three.sum(axis=2, keepdims=True) + 0.64))
    weights = {f: rng.uniform(0.5, 3) for w in words for f in toxicity.features(w)} | {"ab$": 1.0, "^lett": 0.4}
    model = toxicity.Model(characters, weights, (0.5, 0.4, 0.3, -0.1, -1.0))

    def odd(w: str) -> str:
        like = lambda ch: [k for k, v in toxicity.IMITATES.items() if ch in v] or [ch]
        return rng.choice(["", "", "!", "1", "("]) + "".join(rng.choice([ch, ch, ch, ch * 2, rng.choice(like(ch)), ch + rng.choice(".-*_1€²")]) for ch in w) + rng.choice(["", "!!", "$$$", ".", "s"])

    texts = ["", "idi ot", "lo s er", "ab", "x " * 5 + "s h i t"] + [" ".join(rng.choice([odd, str, lambda w: w[:2] + " " + w[2:]])(rng.choice([*words, "letter", "xyzzy"])) for _ in range(rng.randint(1, 3))) for _ in range(1500)]

    def plainly(text: str) -> float:
        restore = toxicity.Restorer(characters)
        tokens, more = restore.tokens(text.lower())
        found = more + [r for w in tokens for r in restore.word(w)]
        found += [w for i in range(len(tokens)) for n in (2, 3) if (w := "".join(tokens[i : i + n])) + "$" in weights and toxicity.decode(" ".join(tokens[i : i + n]), restore.model) == w]
        held: dict[str, float] = {}
        for f in (f for w in found for f in toxicity.features(w)):
            held[toxicity.begins(f)] = max(held.get(toxicity.begins(f), 0.0), weights.get(f, 0.0))
        return 1 / (1 + np.exp(-np.dot(toxicity.evidence(held, len(tokens)), model.fit)))

    want = [plainly(t) for t in texts]
    assert len({round(x, 9) for x in want}) > 300 and toxicity._scorer(model)(texts) == pytest.approx(want, abs=1e-12)
    decode, calls = toxicity.decode, []
    monkeypatch.setattr(toxicity, "decode", lambda *a: calls.append(a[0]) or decode(*a))
    # Idle words that begin like weighed ones, or look disguised: no reading of theirs can weigh more than what is plain.
    idle = [f"{w}{a}{a}{b}{end}" for w in ("idio", "moro", "lose", "zzz") for a in "xyz" for b in "qk" for end in ("", "!!", "$$$")]
    toxicity._scorer(model)([" ".join(idle)])
    assert not calls
    gc.collect()
    gc.disable()
    try:
        rate = toxicity._scorer(model)
        rate(texts[:50])
        kept = weakref.ref(rate.__closure__[[*rate.__code__.co_freevars].index("restore")].cell_contents)
        del rate
        assert kept() is None
    finally:
        gc.enable()


def test_toxicity_counts_alike_training_rows(spark):
    """Documents that share half of their shingles, or all with another label, are no near copies."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    say = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20))
    shared = " ".join(f"shared{chr(97 + j)}" for j in range(24))
    rows = [(i, f"{shared} zonker {say(i)}") for i in ids[:8]] + [(i, say(i)) for i in ids[8:60]] + [(i, f"{shared} zonker {say(ids[0])}") for i in ids[60:62]]
    labels = [(i, int(n < 8)) for n, (i, _) in enumerate(rows)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    base = 8 / 61  # the last two are copies of each other, and of the first with another label
    odds = np.log((8 + 5 * base) / (1 + 5 * (1 - base))) - np.log(base / (1 - base))
    assert model.weights["zonker$"] == pytest.approx(odds)


def test_sample_without_copies(spark, docs):
    """What goes repeats what stays, with the same label; copies and near copies go."""
    rows = [(r.doc_id, r.text, r.doc_id % 2) for r in docs.collect()] + [(900, None, 0), (902, "", 0), (903, " ", 1), (None, "no id", 1)]
    kept = [r.doc_id for r in near.without_copies(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), "toxic").collect()]
    assert len(set(kept)) == len(kept)
    parts = [brute.near([(i, t) for i, t, y in rows if y == label and i is not None]) for label in (0, 1)]
    group = {i: (label, part[i][1]) for label, part in enumerate(parts) for i in part}
    empty = {i: (y, None) for i, t, y in rows if i is not None and not (t or "").split()}
    group |= empty
    assert {group[i] for i in kept} == set(group.values())  # each group stays
    assert sum(group[i] == (0, None) for i in kept) == 1 and len(kept) < len(group)
    alike = brute.sets([(i, t) for i, t, _ in rows])
    for i in set(group) - set(kept) - set(empty):
        near_one = [j for j in group if j != i and j % 2 == i % 2 and 100 * len(alike[i] & alike[j]) >= 85 * len(alike[i] | alike[j])]
        assert near_one
    assert near.without_copies(spark.createDataFrame([], "doc_id long, text string, toxic int"), "toxic").count() == 0


def _every_reading(token: str, run: int) -> set[tuple[float, str]]:
    """All plain texts of a token with their channel costs, by going through the whole lattice."""
    long_run, i = set(), 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        if j - i >= max(2, run):
            long_run |= set(range(i + 1, j))
        i = j
    made = {(0.0, "")}
    for place, ch in enumerate(token):
        options = [(x, toxicity.DISGUISE) for x in toxicity.IMITATES.get(ch, "")]
        if ch.isalpha():
            options.append((ch, 0.0))
        else:
            options += [("", toxicity.LOST), (" ", toxicity.LOST)] if ch in toxicity.IMITATES else [("", toxicity.DROP), (" ", 0.0)]
        options += [("", toxicity.REPEAT)] if place in long_run else []
        made = {(cost + extra, text + x) for cost, text in made for x, extra in options}
    return made


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aiost10!$-. ", min_size=1, max_size=6), st.sampled_from([2, 3]), st.integers(0, 5))
def test_decoding_is_the_best_of_all_readings(token, run, seed):
    rng = np.random.default_rng(seed)
    size = toxicity.SIZE
    model = np.log(rng.dirichlet(np.ones(size), (size, size)))

    def total(cost: float, text: str) -> float:
        """Channel costs plus the language model's, with one boundary between words and at both ends."""
        words = text.split()
        codes = [0, 0]
        for n, w in enumerate(words):
            codes += ([0] if n else []) + toxicity.classes(w).tolist()
        codes += [0] if words else []
        return cost - sum(model[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    best = min(total(cost, text) for cost, text in _every_reading(token, run))
    found = toxicity.decode(token, model.tolist(), run)
    assert min(total(cost, text) for cost, text in _every_reading(token, run) if " ".join(text.split()) == found) == pytest.approx(best)


@pytest.mark.parametrize("run", [lines.dedup_lines, repeats.remove_repeats, near.near_groups, lambda d: pii.sanitise(d)])
def test_empty_table(docs, run):
    assert run(docs.where("false")).count() == 0


def test_repeated_rows_do_not_crash(docs):
    some = docs.where("doc_id < 60").coalesce(1)
    twice, n = some.unionByName(some), some.count()
    assert lines.dedup_lines(twice).count() == repeats.remove_repeats(twice).count() == pii.sanitise(twice).count() == 2 * n
    assert near.near_groups(twice).count() == n


def test_line_dedup_of_rows_without_an_id(spark):
    line, own = "This line is in very many documents of the table", "A line of the nameless one alone, long enough to count"
    rows = [(i, line) for i in range(5)] + [(None, f"{line}\n{own}\nshort"), (None, f"{own} too\n{line}")]
    got = [(r.doc_id, r.kept_text, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x[1:] for x in got if x[0] is None) == [(f"{own}\nshort", 1), (f"{own} too", 1)]
    assert sorted(x for x in got if x[0] is not None) == [(0, "", 1), (1, "", 1), (2, "", 1), (3, "", 1), (4, line, 0)]


def test_near_stage_keeps_rows_without_an_id(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "x y z"), (None, None)]
    kept = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "x y z"), (1, "a b c d e f")]


def test_warc_of_repeated_rows(spark):
    big = "<p>é</p>" * 20_000
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", big), (2, "v", big), (1, "u", big), (None, "u", "b"), (None, "u", "b"), (3, "u", "c")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got.collect()) == sorted((i or 0, len(t.encode()), "revisit" if i == 1 and t == big else "response", 2 if i == 1 and t == big else None) for i, _, t in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\naBéñ ", max_size=30), min_size=1, max_size=8))
def test_words_and_windows(texts):
    w = words(pa.array(texts))
    cut = [brute.WORD.findall(brute.low(t)) for t in texts]
    assert np.diff(w.first).tolist() == [len(c) for c in cut]
    seen = {}
    for h, word in zip(w.hashes.tolist(), [x for c in cut for x in c], strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    flat = [x for c in cut for x in c]
    for k in (1, 2, 3, 5):
        grams = {}
        for h, g in zip(windows(w.hashes, k).tolist(), [tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)], strict=True):
            assert grams.setdefault(g, h) == h
        assert len(set(grams.values())) == len(grams)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 9))
def test_window_minima(values, w):
    v = np.array(values, dtype=np.uint64)
    want = sorted({max(range(i, i + w), key=lambda j: (-values[j], j)) for i in range(len(values) - w + 1)})
    assert window_minima(v, w).tolist() == want


def test_likeness_of_short_texts():
    texts = ["a b c d e", "v w x y z", "a b c d e", "", "q"]
    code, empty = fingerprints.codes(texts, 5, 1024, 4)
    one = lambda i, j: sketch.likeness(code[i : i + 1], code[j : j + 1], empty[i : i + 1], empty[j : j + 1], 4)[0]
    assert one(0, 2) == 1 and one(0, 1) < 0.1 and one(3, 3) == 1 and one(3, 0) == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    d = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    spark.createDataFrame([(i, int(i % 9 == 0)) for i, _ in DOCS], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(DOCS[-1][1].split()[50:70]) if DOCS[-1][1] else "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        made = stage(spark, now, str(tmp_path))
        assert made.columns == d.columns, name
        after = {r.doc_id: r.text for r in made.collect()}
        if name == "toxicity":
            told = toxicity.toxicity(now, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
            assert set(after) == {r.doc_id for r in told if not r.predicted}
        elif name == "line_dedup":
            assert {i: t or "" for i, t in after.items()} == {i: x[2] for i, x in brute.lines(list(before.items())).items()}
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near(list(before.items()), 80).items() if i == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]
            assert set(after) == {i for i, x in brute.contaminated(list(before.items()), items).items() if not x[1]}
        made.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    rows, held = last.collect(), {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(held) == {r.doc_id for r in now.collect()}
    for parts in held.values():  # each token lies in exactly one piece
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == parts[0][2]


def plain_disclosures(rows, generalise, prior):
    """Terms and their greatest share of an entity's information, counted one by one."""
    import math
    import re

    base = re.compile("|".join(f"(?:{p})" for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[\x20-]?[0-9]){11,}", r"\+[0-9][\x20().0-9-]+[0-9]")))
    words = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    n, held = len(rows), {}
    for i, text in rows:
        for kind, a, b in brute.personal(text or ""):
            said = text[a:b]
            digits = re.sub("[^0-9]", "", said)
            one = digits if kind in ("card", "phone") else said.lower()
            head = {"email": said.rsplit("@")[-1].lower(), "ip": ".".join(said.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
            for e in (f"{kind}:{one}", f"{kind} of {head}", f"{kind}s"):
                held.setdefault(e, set()).add(i)
    out = {}
    texts = dict(rows)
    for e, ids in held.items():
        for t in set().union(*(words(base.sub("\n", texts[i])) for i in ids)):
            if len(ids) < n:
                both = sum(t in words(base.sub("\n", texts[i])) for i in ids)
                share = 1 - math.log(both / (sum(t in words(x or "") for x in texts.values()) + prior)) / math.log(len(ids) / n)
                if share >= generalise:
                    out[t] = max(out.get(t, 0), share)
    return out


@pytest.mark.parametrize(("generalise", "most"), [(0.85, 200_000), (0.5, 0)])
def test_pii_terms_are_those_of_the_counts(spark, monkeypatch, generalise, most):
    import random

    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
    r = random.Random(9)
    word = lambda: "w%d" % int(r.paretovariate(0.6))
    private = ["ann@corp.com", "bob@corp.com", "joe@home.org", "10.0.0.7", "+1 212 555 0199 00", "4111 1111 1111 1111"]
    rows = []
    for i in range(120):
        text = [word() for _ in range(r.randrange(3, 25))]
        if i % 4 == 0:
            text.insert(2, r.choice(private))
            text.append("Zanzibar" if "corp.com" in " ".join(text) else "x")
        rows.append((i, " ".join(text)))
    rows += [(500, "Zanzibar is at home"), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_disclosures(rows, generalise, 1.0)
    held = pii.holders(docs)
    got = {x.term: x.d for x in pii.disclosing_terms(pii.documents(docs), held, generalise).groupBy("term").agg(F.max("disclosure").alias("d")).collect()}
    assert got == pytest.approx(want) and len(want) > (5 if generalise < 0.8 else 0) and "zanzibar" in want
    done = {x.doc_id: x for x in pii.sanitise(docs, generalise).collect()}
    assert done[500].sanitised.split() == [w for w in ("[term]" if want["zanzibar"] < 0.95 else "", "is", "at", "home") if w]
    for i, text in rows:
        terms = [s.text.lower() for s in done[i].spans if s.kind == "term"]
        assert set(terms) <= set(want) and (i < 500 or len(terms) == (i == 500))


def test_pii_entities_seen_once(spark):
    """A word that stands with an entity in the only text of either gives it away."""
    rows = [(0, "Mail boss@corp.com in Zanzibar now")] + [(i, f"now some text number {i % 7} in here") for i in range(1, 400)]
    got = {x.doc_id: x for x in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {s.text for s in got[0].spans if s.kind == "term"} == {"Mail", "Zanzibar"} and got[1].sanitised == rows[1][1]


def test_pii_address_parts(spark):
    texts = ["10.0.0.1", "0.0.0.0", "000.00.255.1", "256.0.0.1", "1.2.3.0256", "0255.1.2.3", "a 10.0.0.256 b", "255.255.255.255", "1.2.3.4.5.6.7.8", "100.20.00300.1"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute.personal(t) for i, t in enumerate(texts)} and len(got[0]) == len(got[1]) == 1
