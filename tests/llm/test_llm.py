"""The training-data operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat, decontaminate, kernels, licenses, line_dedup, near_dedup, packing, quality, warc
from lakeloom.llm import queries as llm_queries
from lakeloom.llm.block_dedup import block_dedup
from lakeloom.llm.suffix_dedup import suffix_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, h string, pos string, t string, bucket string, id string, gone string, n_words string, marks string, _once string"
WORD = r"[^\x20\x09-\x0D]+"


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(n))


def odd_rows():
    a, b, c = sentence(1, 120), sentence(2, 80), sentence(3, 60)
    texts = {
        1: a, 2: a, 3: f"{b} {a}", 4: f"lead {c}\n{b}\ntail", 5: None, 6: "", 7: " \t\n ", 8: "word", 9: "x " * 500, 10: "é ß ñ 中文 🙂 " * 30,
        11: sentence(4, 30_000), 12: f"{b[:300]} cut {b[300:]}", 13: "line one\nline two\nline three\nline one\nline two\nend", 14: "line one\nline two\nother", 15: a.replace(a.split()[60], "changed"),
        16: "Licensed under CC BY-NC 4.0.\nSPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0", 17: "SPDX-License-Identifier: MIT OR", 18: "all rights reserved All Rights Reserved",
        19: "# $ % & | < > *** " * 20, 20: "a\r\nb\x0bc\x0cd\x1ce",
    }
    rows = [(k, v, "en" if k % 2 else None, None if k % 3 else "s", None, 1, "h", "p", "t", "b", "i", "g", "w", "m", "o") for k, v in texts.items()]
    return [*rows, rows[2], rows[2], (None, b, "en", "s", 3, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "small", "empty"])
def docs(request, spark):
    if request.param == "empty":
        return spark.createDataFrame([], SCHEMA)
    return request.getfixturevalue(request.param)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def covered(units, width):
    seen = Counter(u[i : i + width] for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = bytearray(len(u))
        for i in range(len(u) - width + 1):
            if seen[u[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append(gone)
    return out


def test_suffix_dedup(docs):
    own = [(d, x.encode()) for d, x in pairs(docs)]
    want = []
    for (d, u), g in zip(own, covered([u for _, u in own], 200), strict=True):
        kept = bytes(x for x, k in zip(u, g, strict=True) if not k)
        want.append((d, len(u), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    assert rows_of(suffix_dedup(docs)) == sorted(want, key=repr)


def test_block_dedup(docs):
    own = [(d, tuple(re.findall(WORD, x))) for d, x in pairs(docs)]
    want = []
    for (d, u), g in zip(own, covered([u for _, u in own], 35), strict=True):
        kept = " ".join(x for x, k in zip(u, g, strict=True) if not k)
        want.append((d, len(u), sum(g), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(block_dedup(docs)) == sorted(want, key=repr)


def test_licenses(docs):
    want = []
    for d, x in pairs(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        hits = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    got = licenses.license_scan(docs)
    assert rows_of(got.drop("labels", "score")) == sorted(want, key=repr)
    for r in got.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_expressions():
    assert licenses.evaluate("(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 */") == (frozenset({"mit", "apache-2.0", "gpl-2.0-only with classpath-exception-2.0"}), 0.2)
    assert licenses.evaluate("MIT OR GPL-3.0 AND AGPL-3.0")[1] == 0.1
    assert all(licenses.evaluate(x) is None for x in ("MIT OR", "(MIT", "", "AND MIT", "()"))


def test_license_tags_and_long_texts(spark):
    texts = {1: "SPDX License Identifier: MIT", 2: "the SPDX-License-Identifier tag", 3: "spdx-license-identifier = Apache-2.0 OR MIT\nSPDX_License_Identifier: ISC", 4: "cc by " * 100_000, 5: "SPDX-License-Identifier:"}
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4, 5)] == ["mit", "", "apache-2.0,isc,mit", "cc-by", "invalid-expression"]
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (100_000, 0, 199_998)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack_documents(docs).collect()
    windows, left = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append(r)
        left[r.doc_id].append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at and r.tier == w[0].tier <= 4096 and r.step_group == w[0].step_group
            at += r.length
        assert at == w[0].tier and at & (at - 1) == 0
    groups = defaultdict(Counter)
    for w in windows.values():
        groups[w[0].tier][w[0].step_group] += w[0].tier
    assert all(n == packing.STEP_IDS for g in groups.values() for n in sorted(g.values())[1:]) and all(n <= packing.STEP_IDS for g in groups.values() for n in g.values())
    for d, x in pairs(docs):
        ids = np.array([*tokenizer.encode(x, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        while at < len(ids):  # repeated rows: any piece of the right place and content, used once
            r = next(r for r in left[d] if r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()))
            left[d].remove(r)
            at += r.length
        assert at == len(ids)
    assert not any(left.values())


def test_special_tokens_in_capitals():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    texts = ["A <|ENDOFTEXT|> b", "Word<|StartOfText|>Word", "<|endoftext|> End", "x<|y <| Z|>", "PLAIN Words, too"]
    want = [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode([x.encode() for x in texts], path)] == want


def test_quality(docs):
    want = []
    for d, x in pairs(docs):
        w = re.findall(WORD, x)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [y for y in x.split("\n") if re.search(WORD, y)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    got = quality.quality_scores(docs)
    assert rows_of(got.drop("kept", "lang", "source")) == sorted(want, key=repr)
    assert not got.where("kept and base_failed").count()
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_quality_fences(spark):
    rows = [(i, sentence(i, 40), "en", "a") for i in range(300)] + [(900, "### " * 10 + sentence(1, 40), "en", "a"), (901, sentence(7, 40).upper(), "en", "rare")]
    got = {r.doc_id: r.kept for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900] and not got[901] and sum(got.values()) == 300


def exact_quantile(values, q):
    """What a sketch that holds all values gives: the least value whose rank, itself included, reaches q."""
    return sorted(values)[max(0, math.ceil(q * len(values) - 1e-9) - 1)]


def test_quality_verdicts_equal_brute_force(spark):
    """Up to SKETCH_K rows a group the sketches are exact, so are the fences."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = quality.measures(docs, "doc_id", "lang", "source").collect()
    ratio = lambda r, name: (lambda a, b: r[a] / r[b] if r[b] else 0.0)(*quality.RATIOS[name][0].split(" / "))
    passed = [r for r in rows if not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)]
    groups = {"all": passed}
    for r in passed:
        groups.setdefault(r.lang, []).append(r)
        groups.setdefault((r.lang, r.source), []).append(r)

    def fences(key, name):
        _, side, between, times, least = quality.RATIOS[name]
        low, high = (exact_quantile([ratio(r, name) for r in groups[key]], q) for q in between)
        far = max(times * (high - low), least)
        return (low - far if side == "both" else -math.inf), high + far

    def shrunk(r, name):
        weight = lambda key: len(groups[key]) / (len(groups[key]) + quality.PRIOR_ROWS)
        out = fences("all", name)
        for key in (r.lang, (r.lang, r.source)):
            own = fences(key, name)
            out = tuple(weight(key) * a + (1 - weight(key)) * b if math.isfinite(a) else a for a, b in zip(own, out, strict=True))
        return out

    want = {}
    for r in rows:
        ok = r in passed
        for name in quality.RATIOS if ok else ():
            low, high = shrunk(r, name)
            ok &= low - 1e-12 <= ratio(r, name) <= high + 1e-12
        want[r.doc_id] = ok
    got = {r.doc_id: r.kept for r in quality.quality_scores(docs).collect()}
    assert got == want and 0 < sum(want.values()) < len(passed)


def test_small_groups_change_smoothly():
    """No size at which a group's own quantiles begin or cease to count."""
    weights = [n / (n + quality.PRIOR_ROWS) for n in range(1, 400)]
    assert all(0 < b - a < 0.05 for a, b in zip(weights, weights[1:], strict=False))


def with_ratio(name, level, seed):
    """A text of 100 words and 20 lines in which a ratio is about level and the others are plain."""
    r = np.random.default_rng(seed)
    word = lambda n: "".join(r.choice(list("abcdefghij"), n))
    sizes = r.integers(4, 7, 100) + (round(level) if name == "word_length" else 0)
    words = [word(n) for n in sizes]
    if name == "symbol_ratio":
        words[: round(100 * level)] = [w + "#" for w in words[: round(100 * level)]]
    if name == "upper_ratio":
        words[: round(100 * level)] = [w.upper() for w in words[: round(100 * level)]]
    if name == "repeat_ratio" and level:
        words[50 : 50 + round(50 * level)] = words[: round(50 * level)]
    lines = [" ".join(words[i : i + 5]) for i in range(0, 100, 5)]
    if name == "dup_line_ratio":
        lines[1 : 1 + round(20 * level)] = ["-"] * round(20 * level)
    return "\n".join(lines)


@pytest.mark.parametrize("name, plain, usual, probe", [("word_length", 0, 3, 3), ("symbol_ratio", 0, 0.3, 0.3), ("dup_line_ratio", 0, 0.5, 0.25), ("repeat_ratio", 0, 0.12, 0.12), ("upper_ratio", 0.02, 0.2, 0.2)])
def test_quality_groups_differ(spark, name, plain, usual, probe):
    rows = [(2 * i + k, with_ratio(name, level, 2 * i + k), "en", source) for i in range(250) for k, (level, source) in enumerate([(plain, "plain"), (usual, "usual")])]
    rows += [(k, with_ratio(name, probe, 9999), "en", source) for k, source in ((-1, "plain"), (-2, "usual"))]
    got = {r.doc_id: r.kept for r in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[-1] and got[-2] and sum(got.values()) == 501


@pytest.mark.parametrize("alone", [None, line_dedup.ALONE_WORDS])
def test_lines(docs, alone):
    rows = sorted({(d is not None, d or 0, x) for d, x in pairs(docs)})
    order = sorted(((d if known else -(1 << 63), x) for known, d, x in rows), key=lambda r: r[0])
    places = defaultdict(list)
    for d, x in order:
        ls = x.split("\n")
        for i, line in enumerate(ls):
            if i + 1 < len(ls):
                places[line, ls[i + 1]].append((d, x, i))
            if alone is not None and len(re.findall(WORD, line)) >= alone:
                places[line,].append((d, x, i))
    first, later = defaultdict(set), defaultdict(set)
    for run, found in places.items():
        for k, (d, x, i) in enumerate(found if len(found) > 1 else ()):
            (later if k else first)[d, x].update(range(i, i + len(run)))
    want = {}
    for d, x in order:
        ls, gone = x.split("\n"), later[d, x] - first[d, x]
        want[d, x] = (len(ls), len(gone), hashlib.sha256("\n".join(y for i, y in enumerate(ls) if i not in gone).encode()).hexdigest())
    expected = sorted(((d, *want[-(1 << 63) if d is None else d, x]) for d, x in pairs(docs)), key=repr)
    got = line_dedup.line_digests(docs, alone=alone)
    assert rows_of(got.drop("n_runs")) == expected
    full = line_dedup.deduplicated(docs)
    assert full.columns[:-3] == docs.columns and full.count() == docs.count()


def test_longer_line_runs(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nx\na\nb\nc"), (3, "b\nc\nd")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "a\nb\nx", 3: ""}


def test_overlapping_line_runs_keep_their_first_copies(spark):
    rows = [(1, "z\nz\nz"), (2, "a\nb"), (3, "a\nb\nc"), (4, "b\nc"), (5, "z\nz\nq"), (5, "z\nz\nq"), (None, "b\nc\nb\nc")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    # the null id orders first, so b, c stands there; c, b stands once
    assert got == sorted([(None, "b\nc"), (1, "z\nz"), (2, "a\nb"), (3, ""), (4, ""), (5, "q"), (5, "q")], key=repr)


def test_lines_that_repeat_alone(spark):
    import corpus_pipeline as P

    hot, long = "one two three four five", sentence(300, 60)
    texts = [f"{hot}\na\n\n{long}\nend", f"b\n{hot}\nc\n\nd", f"{long}", f"e\n{hot}\n{hot}\nf\n{long}", f"{hot}  \n\na b c d\ng", "h\na b c d", None, f"x\ny\n{hot}\nx\ny\nk"]
    rows = [(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)]
    got = {r.doc_id: (r.text, r.n_chars) for r in P.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect()}
    want = [texts[0], "b\nc\n\nd", "", "e\nf", texts[4], texts[5], None, "x\ny\nk"]
    assert {k: x for k, (x, _) in got.items()} == dict(enumerate(want)) and all(n == len(x) for x, n in got.values() if x is not None)


def shingle_counts(text):
    w = re.findall(WORD, text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicates(docs):
    own = pairs(docs)
    texts = sorted({x for _, x in own})
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shingles = {x: shingle_counts(x) for x in texts}
    index = defaultdict(list)
    for x in texts:
        for s in shingles[x]:
            index[s].append(x)
    for x, y in {(x, y) for v in index.values() for x in v for y in v if x < y}:
        common = sum((shingles[x] & shingles[y]).values())
        if common >= 0.8 * (sum(shingles[x].values()) + sum(shingles[y].values()) - common):
            parent[find(x)] = find(y)
    least: dict = {}
    for d, x in own:
        k = find(x)
        least[k] = min((v for v in (least.get(k), d) if v is not None), default=None)
    assert rows_of(near_dedup.near_duplicate_classes(docs)) == sorted(((d, least[find(x)]) for d, x in own), key=repr)
    one = near_dedup.one_of_each_class(docs)
    assert one.columns == docs.columns and one.count() == len({find(x) for _, x in own}) - (len({find(x) for d, x in own if d is None} - {find(x) for d, x in own if d is not None}) > 1)


def test_one_row_of_each_class_whatever_its_id(spark):
    lone = [(None, sentence(100 + i, 40)) for i in range(20)]  # classes without an id
    base = sentence(200, 100)
    near = base.replace(base.split()[50], "changed")
    rows = [*lone, (1, base), (1, sentence(201, 40)), (2, sentence(202, 40)), (2, near), (None, near), (3, None), (3, ""), (4, lone[0][1]), (5, sentence(203, 40)), (5, sentence(203, 40))]
    got = [tuple(r) for r in near_dedup.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [*lone[1:], (4, lone[0][1]), (1, base), (1, sentence(201, 40)), (2, sentence(202, 40)), (3, ""), (5, sentence(203, 40))]
    assert sorted(((d, x or "") for d, x in got), key=repr) == sorted(want, key=repr)


def test_signatures_estimate_similarity():
    import pyarrow as pa

    errors = []
    for n in (6, 60, 600, 3000):
        for seed in range(8):
            a = sentence(seed, n).split()
            b = [w if i % 37 else f"{w}x" for i, w in enumerate(a)]
            x, y = shingle_counts(" ".join(a)), shingle_counts(" ".join(b))
            cells, doc = near_dedup.shingles(*kernels.flat(pa.array([" ".join(a), " ".join(b)])))
            s = near_dedup.signatures(cells, doc, 2)
            errors.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_large_bucket_with_strays(spark):
    """Copies with changes of their own, copies of copies that share changes, and strays that are linked to one another only."""
    base = sentence(5, 100).split()
    change = lambda words, places, mark: [f"{mark}{j}" if j in places else w for j, w in enumerate(words)]
    rows = [(i, change(base, {i * 7 % 100, i * 13 % 100}, f"v{i}")) for i in range(30)]
    far = change(base, set(range(10, 90, 12)), "f")  # under 0.8 to the base
    rows += [(100 + i, change(far, {i * 11 % 100}, f"w{i}")) for i in range(6)]
    rows += [(200 + i, change(rows[i][1], {50 + i, 70 + i, 95 - i}, "shared")) for i in range(8)] + [(300, base[:88]), (301, [*base, *"abcdefgh"])]
    test_near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))


def test_members_of_a_large_bucket_meet_on_prefixes_of_both_sides(spark, monkeypatch):
    """Variants of one source whose changes are drawn from a few words: few of the pairs that share one are compared, and no link is lost."""
    pick, base = np.random.default_rng(7), sentence(6, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 241):
        words = list(base)
        for j in pick.choice(150, pick.integers(2, 7), replace=False):
            words[j] = f"v{pick.integers(3)}"
        rows.append((i, " ".join(words)))
    compared, near = [], near_dedup._near
    monkeypatch.setattr(near_dedup, "_near", lambda pairs, *a: compared.append(pairs.count()) or near(pairs, *a))
    test_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(compared) >= 2 and max(compared[1::2]) < 1000


def test_near_duplicates_of_the_larger_tables(spark):
    """Every link of at least 0.8 that a shingle index finds at sf0.01 is inside one class, and classes hold nothing else."""
    test_near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    a, b = items[0][1].split(), items[1][1].split()
    cut = len(a) // 2
    more = [(1001, f"pre {' '.join(a)} post"), (1002, " ".join(a[cut:] + ["x", "y"] + a[:cut])), (1003, " ".join(b[:8]) + " clean"), (1004, sentence(9, 200)), (1005, None)]
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(own, bench).collect()}
    assert {(1001, items[0][0]), (1002, items[0][0])} <= got and not {d for d, _ in got} & {1003, 1004, 1005}
    norm = lambda x: f" {' '.join(re.findall(r'[^\W_]+', x.lower()))} "
    whole = {(d, i) for d, x in pairs(own) for i, y in items if y.strip() and norm(y) in norm(x)}
    assert whole <= got
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = {d for d, _ in got}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(d) for d, _ in pairs(docs) if d not in bad)
    assert not decontaminate.contaminations(own, bench.limit(0)).count()


def plain_tiles(text, item, least):
    """The longest match of free words, of equal ones the first, again and again."""
    a, b, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and a[i + k] and b[j + k] and text[i + k] == item[j + k]:
                    k += 1
                best = min(best, (-k, i, j))
        k, i, j = -best[0], best[1], best[2]
        if k < least:
            return out
        out.append((i, j, k))
        a[i : i + k] = b[j : j + k] = [False] * k


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_tiles_equal_plain_tiling(letters):
    r = np.random.default_rng(letters)
    for _ in range(60):
        text, item = (r.integers(1, letters + 1, r.integers(1, 40)).astype(np.uint64) for _ in range(2))
        assert decontaminate.tiles(text, item, 3) == plain_tiles(text.tolist(), item.tolist(), 3)


def test_contaminations_equal_brute_force(spark):
    """Every document against every item, without seeds or index."""
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda x: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").lower())
    ids = defaultdict(lambda: len(ids) + 1)
    number = lambda x: np.array([ids[w] for w in words(x)], np.uint64)
    items = [(r.item_id, number(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        text = number(r.text)
        for i, item in items:
            near = np.isin(item, text)
            if len(item) >= decontaminate.SEED and near.mean() >= decontaminate.COVERAGE and 2 * sum(k for _, _, k in decontaminate.tiles(text, item)) >= len(item):
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, bench).collect()} == want and want


def test_blocks_and_equal_items(spark, monkeypatch):
    text = sentence(77, 30)
    docs = spark.createDataFrame([(1, f"lead {text} tail", 0), (2, sentence(78, 30), 0), (3, None, 0)], "doc_id long, text string, k1 long")
    bench = spark.createDataFrame([(7, text, 1), (8, text, 1), (None, text, 1), (9, sentence(79, 30), 1), (10, None, 1)], "item_id long, text string, k2 long")
    for size in (8 << 20, 64):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert rows_of(decontaminate.contaminations(docs, bench)) == sorted([(1, i, 1.0, 1) for i in (7, 8, None)], key=repr)
        assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_tiles_of_repetitive_texts():
    text, item = np.ones(20_000, np.uint64), np.ones(8_000, np.uint64)
    assert decontaminate.tiles(text, item) == [(0, 0, 8_000)]


def test_tiles_are_greedy_and_disjoint():
    item, text = np.arange(1, 31, dtype=np.uint64), np.array([*range(16, 31), 99, *range(1, 16), 98, *range(5, 12)], np.uint64)
    got = decontaminate.tiles(text, item)
    assert sorted(k for _, _, k in got) == [15, 15]


def test_revisits(spark):
    rows = [
        (1, "http://a.com/x?b=1&a=2#f", 10, "response", "p1", {"etag": '"1"', "content-type": "t", "date": "d1"}),
        (2, "https://www.A.com:443/x/?a=2&utm_source=z&b=1", 20, "revisit", None, {"etag": 'W/"1"', "date": "d2", "content-length": "0"}),
        (3, "http://a.com/x?a=2&b=1", 20, "response", "p2", {"etag": '"2"'}),
        (4, "http://a.com/x?a=2&b=1", 30, "revisit", None, {"etag": '"1"'}),
        (5, "http://a.com/y", 5, "revisit", None, None),
        (6, None, 5, "revisit", None, {"etag": '"1"'}),
        (7, "http://b.com", 1, "response", "p3", {"last-modified": "m"}),
        (8, "http://b.com/", 90_000, "revisit", None, {"last-modified": "m"}),
        (9, "http://b.com/", None, "revisit", None, {}),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, payload_digest string, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve_revisits(frame).collect()}
    assert {k: (r.status, r.source_id) for k, r in got.items()} == {2: ("resolved", 1), 4: ("validator_mismatch", None), 5: ("no_earlier_response", None), 6: ("no_earlier_response", None), 8: ("resolved", 7), 9: ("no_earlier_response", None)}
    assert got[2].headers == {"etag": 'W/"1"', "content-type": "t", "date": "d2"} and got[2].payload_digest == "p1"
    assert warc.resolve_revisits(frame.limit(0)).count() == 0
    assert rows_of(warc.resolve_revisits(frame, block=7).select("record_id", "source_id")) == rows_of(warc.resolve_revisits(frame).select("record_id", "source_id"))


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = llm_queries.queries()[name](spark, DATA), c.sql(llm_queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.select(*want.columns)) == sorted(want.fetchall(), key=repr)


def test_transcripts(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    plain = chat.transcripts(conv).persist()
    model = chat.train(plain.where("conv_id % 2 = 0"))
    got, want = defaultdict(list), defaultdict(list)
    for r in chat.parse_transcripts(plain.where("conv_id % 2 = 1"), model).orderBy("conv_id", "part", "turn").collect():
        got[r.conv_id].append(r.role)
    for r in conv.where("conv_id % 2 = 1").orderBy("conv_id", "turn").collect():
        want[r.conv_id].append(r.role)
    assert sum(got[k] == v for k, v in want.items()) > 0.75 * len(want)


def test_addresses_without_scheme_or_host(spark):
    rows = [
        (1, "example.com/a", 1, "response", "p1", {"etag": "x"}), (2, "other.org/b", 2, "revisit", None, {"etag": "x"}), (3, "//Example.com/a/", 3, "revisit", None, {"etag": "x"}),
        (4, "/c", 1, "response", "p4", {"etag": "x"}), (5, "/c", 2, "revisit", None, {"etag": "x"}), (6, "", 2, "revisit", None, {"etag": "x"}), (7, "?q=1", 3, "revisit", None, {"etag": "x"}),
    ]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "record_id long, url string, ts long, kind string, payload_digest string, headers map<string,string>, url_key string, body string")
    got = {r.record_id: (r.status, r.source_id, r.url_key) for r in warc.resolve_revisits(frame).collect()}
    assert got[3] == ("resolved", 1, "example.com/a") and got[2] == ("no_earlier_response", None, "other.org/b")
    assert all(got[k] == ("no_earlier_response", None, None) for k in (5, 6, 7))


def plain_viterbi(model, seen):
    """Every path's score by enumeration of states line by line, without NumPy."""
    best = [(model.start[j] + sum(e[j][x] for e, x in zip(model.emit, seen[0], strict=True)), [j]) for j in range(6)]
    for row in seen[1:]:
        best = [max(((score + model.step[path[-1]][j] + sum(e[j][x] for e, x in zip(model.emit, row, strict=True)), [*path, j]) for score, path in best), key=lambda x: x[0]) for j in range(6)]
    return max(best, key=lambda x: x[0])


def some_model(seed):
    r = np.random.default_rng(seed)
    return chat.Model(r.integers(0, 9, 6), r.integers(0, 9, (6, 6)), [r.integers(0, 9, (6, n)) for n in chat.FEATURES.values()])


def test_paths_equal_plain_viterbi():
    for seed in range(20):
        model, r = some_model(seed), np.random.default_rng(seed)
        seen = np.stack([r.integers(0, n, 12) for n in chat.FEATURES.values()], axis=1)
        state = model.path(seen)
        score = model.start[state[0]] + sum(model.step[a, b] for a, b in zip(state, state[1:], strict=False)) + model.scores(seen)[np.arange(12), state].sum()
        assert score == pytest.approx(plain_viterbi(model, seen.tolist())[0])


def test_parts_are_parsed_as_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    rows = [(c, t, chat.ROLES[((c or 7) + t) % 3], f"{sentence(100 * (c or 7) + t, 3 + t % 5)}{'.?x'[t % 3]}") for c in (1, 2, None) for t in range(11)] + [(9, 0, "user", "short")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = chat.transcripts(conv).persist()
    for seed in range(3):
        model = some_model(seed)
        got, want = defaultdict(list), {}
        for r in chat.parse_transcripts(plain, model).orderBy("conv_id", "part", "turn").collect():
            if r.continued:
                got[r.conv_id][-1][1].append(r.text)
            else:
                got[r.conv_id].append((r.role, [r.text]))
        whole = defaultdict(list)
        for r in plain.orderBy("conv_id", "part").collect():
            whole[r.conv_id].append(r.transcript)
        for c, parts in whole.items():
            want[c] = [(role, "".join(text.split())) for role, text, _ in chat.parse(model, "\n".join(parts))]
        assert {c: [(role, "".join("".join(x).split())) for role, x in v] for c, v in got.items()} == want


def test_odd_transcripts(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", ""), (None, 0, "user", "a\n\nb"), (2, 5, "tool", "z"), (2, 5, "tool", "z")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = chat.chat_digests(conv)
    assert got.count() >= 4 and got.where("part is null").count() == 1 and chat.chat_digests(conv.limit(0)).count() == 0


STAGE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontamination", "packing"])
def test_stages_on_odd_and_no_rows(spark, odd, name):
    import corpus_pipeline as P

    stage = dict(P.STAGES)[name]
    rows = odd.select(*STAGE_COLUMNS)
    for docs in (rows, rows.limit(0), odd):
        got = stage(spark, docs, DATA)
        if name == "packing":
            assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert got.columns == docs.columns and got.count() <= docs.count()
            if name == "line_dedup":
                assert got.count() == docs.count()


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Each stage's decisions by definition, on the rows that the one before kept."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    verdict = {r.doc_id for r in quality.quality_scores(docs).where("kept").collect()}
    rows = {i: x for i, x in rows.items() if i in verdict}
    lines = {i: x.split("\n") for i, x in sorted(rows.items())}
    places = defaultdict(list)
    for i, ls in lines.items():
        for k, line in enumerate(ls):
            if len(re.findall(WORD, line)) >= line_dedup.ALONE_WORDS:
                places[line,].append((i, k))
            if k + 1 < len(ls):
                places[line, ls[k + 1]].append((i, k))
    gone, held = set(), set()
    for run, found in places.items():
        if len(found) > 1:
            held |= {(found[0][0], found[0][1] + j) for j in range(len(run))}
            gone |= {(i, k + j) for i, k in found[1:] for j in range(len(run))}
    cut = {i: "\n".join(x for k, x in enumerate(ls) if (i, k) not in gone - held) for i, ls in lines.items()}
    shingles = {i: shingle_counts(x) for i, x in cut.items()}
    group = {i: i for i in cut}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in cut:
        for j in cut:
            if i < j and shingles[i] and shingles[j] and min(sum(shingles[i].values()), sum(shingles[j].values())) >= 0.8 * max(sum(shingles[i].values()), sum(shingles[j].values())):
                common = sum((shingles[i] & shingles[j]).values())
                if common >= 0.8 * (sum(shingles[i].values()) + sum(shingles[j].values()) - common):
                    a, b = sorted((find(i), find(j)))
                    group[b] = a
    empty = [i for i in cut if not shingles[i]]
    first = {}
    for i in empty:
        group[i] = first.setdefault(cut[i], i)
    kept = {i: cut[i] for i in cut if find(i) == i}
    after = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    bad = {r.doc_id for r in decontaminate.contaminations(after, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    packed = P.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept) - bad
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    sizes = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert sizes == {i: len(tokenizer.encode(x, add_special_tokens=False).ids) + 1 for i, x in kept.items() if i not in bad}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, P.written(stage(spark, docs, DATA))
        assert docs.columns == names and docs.count() <= before.count(), name
    assert not decontaminate.contaminations(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count()
    packed = P.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def thue_morse(a, b, rounds=10):
    """Two different sequences with equal polynomial hashes modulo 2**64, whatever the odd base."""
    x, y = [a], [b]
    for _ in range(rounds):
        x, y = x + y, y + x
    return x, y


def test_unequal_sequences_with_equal_sums_stay_apart(spark):
    """A Thue-Morse word and its complement are different lines, words, windows and texts."""
    x, y = ("".join(v) for v in thue_morse("a", "b"))
    data = np.frombuffer((x + y).encode(), np.uint8)
    at = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(kernels.span_hash(kernels.prefix(data), *at).tolist())) == 1 and len(set(kernels.digests(data, *at).tolist())) == 2
    tail = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}")], "doc_id long, text string")
    assert {r.n_removed for r in block_dedup(docs).collect()} == {0}
    alone = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r.n_removed for r in line_dedup.line_digests(alone, alone=1).collect()} == {0}
    assert len({r.class_id for r in near_dedup.near_duplicate_classes(alone).collect()}) == 2
    words = [" ".join(v) for v in thue_morse("alpha", "beta")]
    benchmark = spark.createDataFrame([(7, words[1])], "item_id long, text string")
    wide = spark.createDataFrame([(1, words[0]), (2, words[1])], "doc_id long, text string")
    tiled = decontaminate.tiles(*(decontaminate.word_ids(pa.array([w]))[0] for w in words))
    a, b = (w.split() for w in words)
    assert all(a[i : i + k] == b[j : j + k] for i, j, k in tiled)
    assert 2 in {r.doc_id for r in decontaminate.contaminations(wide, benchmark).collect()}
    both = block_dedup(spark.createDataFrame([(1, words[0]), (2, words[1])], "doc_id long, text string")).collect()
    windows = Counter(tuple(v[i : i + 35]) for v in (a, b) for i in range(len(v) - 34))
    for r in both:
        v = (a, b)[r.doc_id - 1]
        gone = {i + k for i in range(len(v) - 34) if windows[tuple(v[i : i + 35])] > 1 for k in range(35)}
        assert r.n_removed == len(gone)


def test_many_equal_rows(spark):
    """Ten thousand rows alike in id and text: each gets its result, in time that grows with their number."""
    text = sentence(8, 300)
    rows = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    for got, n in ((block_dedup(rows), len(text.split())), (suffix_dedup(rows), len(text))):
        assert {(r.doc_id, r.n_removed, r["count"]) for r in got.groupBy("doc_id", "n_removed").count().collect()} == {(None, n, 10_000)}


def test_colliding_ids_are_told_apart():
    from lakeloom.llm.repeats import repeats_of

    values, ids, weight = np.array([1, 2, 2, 3, 1, 4]), np.zeros(6, np.int64), np.array([1, 1, 1, 1, 1, 2])
    assert repeats_of(ids, weight, lambda some, firsts: values[some] == values[firsts]).tolist() == [True, True, True, False, True, True]
    data = np.frombuffer(b"aa b aa ccccccccccc b", np.uint8)
    start, end, _ = kernels.words(data, np.array([0, len(data)]))
    a, b, c, d, e = kernels.exact_ids(data, start, end).tolist()
    assert a == c and b == e and len({a, b, d}) == 3
