"""Operators 11 to 13 against brute force, on odd rows and on the smallest tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import conversation_repair as repair
from lakeloom.llm import token_files, whitening

DATA = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, rows string, part string, moves long"


def shortest(letters):
    """Cheapest edits by dynamic programming over prefixes of the target, without a grammar."""
    best = None
    for size in range(0, 2 * len(letters) + 4):
        target = "s" * (size % 2) + "ua" * (size // 2)
        if size == 1:
            continue
        row = {0: (0, "")}
        for j in range(1, size + 1):
            if j - 1 in row and target[j - 1] != "s":
                row[j] = (row[j - 1][0] + 3, row[j - 1][1] + "I")
        for x in letters:
            new, cut = {}, 3 * x.isupper()
            for j in range(size + 1):
                ways = []
                if j in row:
                    ways.append((row[j][0] + 4, row[j][1] + "D"))
                if x != "x" and j and j - 1 in row:
                    if x.lower() == target[j - 1]:
                        ways.append((row[j - 1][0] + cut, row[j - 1][1] + "K"))
                    elif target[j - 1] != "s":
                        ways.append((row[j - 1][0] + 3 + cut, row[j - 1][1] + "R"))
                if j and j - 1 in new and target[j - 1] != "s":
                    ways.append((new[j - 1][0] + 3, new[j - 1][1] + "I"))
                if ways:
                    new[j] = min(ways)
            row = new
        if size in row and (best is None or row[size] < best):
            best = row[size]
    return best


def brute_repair(rows):
    """The contract's columns from plain loops over (conv_id, turn, role, text)."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    out = {}
    for conv in {r[0] for r in rows}:
        talk = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            talk += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        talk.sort(key=order)
        faults, seen, letters = [], set(), ""
        for _, role, text in talk:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = shortest(letters)
        size, at, kept = len(audit.replace("D", "")), 0, []
        for x in audit:
            role = "assistant" if (size - len(kept)) % 2 else "user"
            if x != "D":
                kept.append(f"{talk[at][1] if x == 'K' else role}:{'' if x == 'I' else talk[at][2]}")
            at += x != "I"
        turns = [t for t, _, _ in talk if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(talk)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def repaired_rows(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_charts_equal_plain_alignment(seed):
    r = random.Random(seed)
    for n in range(9):
        for _ in range(12):
            letters = "".join(r.choice("suaoSUAO") for _ in range(n))
            assert repair.parsed(letters) == shortest(letters), letters


def test_chained_parts_equal_the_whole():
    """Tables of parts, chained by rank, give the audit of one chart."""
    r = random.Random(5)
    for _ in range(60):
        letters = "".join(r.choice("suaoUA") for _ in range(r.randrange(0, 40)))
        cuts = sorted(r.randrange(len(letters) + 1) for _ in range(r.randrange(1, 5)))
        state = {-1: (0, "")}
        for a, b in itertools.pairwise([0, *cuts, len(letters)]):
            new = {}
            for entry, to, cost, piece in repair.table_of(letters[a:b]):
                if entry in state:
                    found = (state[entry][0] + cost, state[entry][1] + piece)
                    new[to] = min(new.get(to, found), found)
            state = new
        ends = [(state[x][0] + e[0], state[x][1] + e[1]) for x in state if (e := repair.ENDINGS.get(repair.ITEMS[x]))]
        assert min(ends) == repair.parsed(letters)


def odd_talks():
    r, rows = random.Random(1), []
    texts = ["Hello.", "hello", "What? ", "", " \t", None, "é ß 中文!", "Hello.\n"]
    for conv in [*range(30), None]:
        for turn in [*range(r.randrange(0, 9)), None][: r.randrange(1, 9)]:
            for _ in range(r.choice([1, 1, 1, 2])):
                rows.append((conv, turn if r.random() < 0.9 else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts)))
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t % 40}." if t % 3 else "cut") for t in range(90)]  # one long conversation
    rows += [(100, 7, "user", "Again.")] * 30 + [(101, None, None, None)] * 5
    rows += [(102, 1, "user", "x " * 40_000 + "."), (102, 2, "assistant", "y" * 90_000 + "!")]
    return rows


@pytest.mark.parametrize("part_rows", [repair.PART_ROWS, 7])
def test_odd_conversations(spark, part_rows):
    rows = odd_talks()
    frame = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], TALK).repartition(3)
    assert repaired_rows(repair.repair_digests(frame, part_rows)) == brute_repair(rows)


def test_repaired_turns_are_the_output(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi again."), (1, 2, "tool", "Done.")], "conv_id long, turn int, role string, text string")
    (row,) = repair.repaired(frame).collect()
    assert [tuple(x) for x in row.repaired] == [("user", "Hi."), ("assistant", ""), ("user", "Hi again."), ("assistant", "Done.")] and (row.audit, row.cost) == ("KIKR", 6)


def test_no_conversations(spark):
    assert repair.repair_digests(spark.createDataFrame([], TALK)).collect() == []
    assert repaired_rows(repair.repair_digests(spark.createDataFrame([("a", None, "user", "Hi.")], "conv_id string, turn int, role string, text string"))) == brute_repair([("a", None, "user", "Hi.")])


def test_conversations_equal_brute_force(spark):
    frame = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert repaired_rows(repair.repair_digests(frame, 5)) == brute_repair([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def brute_whitening(rows):
    """n, deviations, covariance and mean by plain fractions."""
    from fractions import Fraction

    kept = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(v for _, v in kept), strict=True)]
    mean = [Fraction(s, n) for s in sums]
    apart = [[x - m for x, m in zip(v, mean, strict=True)] for _, v in kept]
    cov = np.array([[float(sum(a[i] * a[j] for a in apart) / n) for j in range(len(sums))] for i in range(len(sums))])
    return n, [(k, sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)), [float(x) for x in a]) for (k, v), a in zip(kept, apart, strict=True)], cov


def assert_whitened(got, rows):
    n, kept, cov = brute_whitening(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, int((values > np.trace(cov) * len(cov) * 2.0**-52).sum()))
    assert len(got) == k * len(kept) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert all(r.identity_error <= 1e-9 for r in got)
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9
    assert set(table) == {(key, d if d < 1 << 63 else None) for key, d, _ in kept}
    for c in range(k):
        want = {}
        for key, d, a in kept:
            want.setdefault((key, d if d < 1 << 63 else None), []).append(float(np.array(a) @ vectors[:, c] / math.sqrt(values[c])))
        off = [max(abs(x - y) for key in want for x, y in zip(sorted(sign * z for z in table[key][c + 1]), sorted(want[key]), strict=True)) for sign in (1, -1)]
        assert min(off) < 1e-6


def test_whitening_equals_fractions(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert_whitened(whitening.whitened(frame).collect(), rows)


EMBEDDED = "vec_id long, embedding array<double>, vector string, n string, i long, component string"


def test_odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=5) * [1, 2, 3, 1000, 1e-1]]) for i in range(60)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (70, [0.0, -0.0, 1e-300, -1e-300, 5.0])]
    bad = [(80, None), (81, [1.0, None, 2.0, 3.0, 4.0]), (82, [1.0, float("nan"), 2.0, 3.0, 4.0]), (83, [1.0, float("inf"), 2.0, 3.0, 4.0]), (84, []), (85, [1.0, 2.0])]
    frame = spark.createDataFrame([(*x, "a", "b", 1, "c") for x in [*rows, *bad]], EMBEDDED).repartition(3)
    assert_whitened(whitening.whitened(frame).collect(), rows)


def test_long_integers_are_exact(spark):
    """Values beyond one limb, and deviations beyond 64 bits."""
    r = np.random.default_rng(4)
    rows = [(i, [float(x) * 1e13, float(y)]) for i, (x, y) in enumerate(r.normal(size=(40, 2)))]
    v = np.array([[math.floor(64 * c) for c in x] for _, x in rows], object)
    n, sums, scatter = whitening.exact_scatter(spark.createDataFrame([(x,) for _, x in rows], "vector array<double>").repartition(4), 2)
    assert (n, sums) == (40, list(v.sum(0))) and scatter == (40 * v.T.dot(v) - np.outer(v.sum(0), v.sum(0))).tolist()
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    want = {i: int(((40 * v[i] - v.sum(0)) ** 2).sum()) for i in range(40)}
    assert {x.vec_id: x.deviation for x in got} == {i: d if d < 1 << 63 else None for i, d in want.items()}


def test_vectors_without_components(spark):
    empty = spark.createDataFrame([], EMBEDDED)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitened(empty).collect() == whitening.whitened(same).collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_vocabulary())


def brute_tokens(rows, tokenizer):
    """(doc_id, n_tokens, crc) of each row, by doc_id."""
    out = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))


def assert_tokens(got, rows, tokenizer):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    want = brute_tokens(rows, tokenizer)
    assert [r[1] for r in got] == [r[0] for r in want]
    assert sorted(r[1:] for r in got if r[1] is not None) == sorted(r for r in want if r[0] is not None)
    assert sorted(r[2:] for r in got if r[1] is None) == sorted(r[1:] for r in want if r[0] is None)
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]


ODD_TEXTS = [
    None, "", " ", "  ", "\n", " lead", "trail ", "two  blanks", "a \n b\n c \t d", "x\u00a0 y \u3000z", "it's we'll 's 't", "12 345six 7", "<|endoftext|> in <|endoftext|>text", "a\x1c b \x1d\x1ec",
    "中文 测试。 日本語", "é ß ñ 🙂 👍🏽", "word " * 3000, "y" * 40_000, "tab\tsep\r\nline \r\n end", "!!!??? ...\u2028 z", "\u017f \u01c5 \u0250 \u02b0 a\u02b0 \u0345", "a. b, (c) d;e", "0", "!",
]


def test_words_are_tokenised_as_in_their_text(tokenizer):
    r, code = random.Random(2), token_files.Coder(token_files.default_vocabulary())
    parts = ["a", "Word", " ", "  ", "\n", "'s", ".", "é", " ", "7", "\t", "中", "!?", " ", "<|", "\x1f", "ß"]
    texts = [x or "" for x in ODD_TEXTS] + ["".join(r.choice(some) for _ in range(r.randrange(1, 30))) for some in (parts, [x for x in parts if token_files.ALIKE.fullmatch(x)]) for _ in range(2000)]
    assert code.plain is not None and sum(token_files.ALIKE.fullmatch(x) is not None for x in texts) > 500
    for _ in range(2):
        assert [np.frombuffer(x, code.kind).tolist() for x in code.encode(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_odd_token_documents(spark, tokenizer):
    rows = [(i, x) for i, x in enumerate(ODD_TEXTS)] + [(3, "again"), (3, "again"), (3, None), (None, "null"), (None, None), (None, "null"), (-5, "less"), (1 << 60, "more")]
    frame = spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], "doc_id long, text string, hash string, n_tokens long, file string, tie string").repartition(3)
    assert_tokens(token_files.token_digests(frame).collect(), rows, tokenizer)
    assert token_files.token_digests(frame.limit(0)).collect() == []


def test_token_documents_equal_brute_force(spark, tokenizer):
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    assert_tokens(token_files.token_digests(frame).collect(), [tuple(r) for r in frame.select("doc_id", "text").collect()], tokenizer)


def test_sequences_are_read_at_their_place(spark, tokenizer, tmp_path):
    """Any sequence equals the same slice of all ids, and is a view of the mapped file."""
    frame = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40")
    manifest = token_files.write_token_files(frame, f"file://{tmp_path}/files", token_files.default_vocabulary(), length=64, rows=4)
    docs = dict(frame.select("doc_id", "text").collect())
    total, first = [x for k in sorted(docs) for x in [*tokenizer.encode(docs[k] or "", add_special_tokens=False).ids, 0]], 0
    files = sorted(manifest.collect())
    for row in files:
        file = token_files.TokenFile(f"{row.path}.arrow")
        want = total[first : first + row.n_ids]
        assert row.sequences == -(-row.n_ids // 64)
        for k in random.Random(1).sample(range(row.sequences), row.sequences):
            ids, mask = file.sequence(k)
            real = min(64, row.n_ids - 64 * k)
            assert ids[:real].tolist() == want[64 * k : 64 * k + real] and mask.tolist() == [True] * real + [False] * (64 - real) and not ids[real:].any()
            mapped = pa.memory_map(row.path.removeprefix("file://") + ".arrow").size()
            assert not ids.flags.owndata and ids.nbytes < mapped
        with pa.memory_map(row.path.removeprefix("file://") + ".arrow") as source:
            assert sum(len(b) for b in pa.ipc.open_stream(source)) == row.sequences
        first += row.n_ids
    assert first == len(total)
    asked = spark.createDataFrame([(files[-1].file, 0), (files[0].file, files[0].sequences - 1)], "file long, sequence long")
    got = {(r.file, r.sequence): r.ids for r in token_files.read_sequences(manifest, asked).collect()}
    assert len(got) == len({(r.file, r.sequence) for r in asked.collect()}) and got[files[-1].file, 0][:5] == total[first - files[-1].n_ids :][:5]
