"""Quality, conversation repair and tokenizer alignment against brute force."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import alignment, conversations, quality
from tarn.llm.alignment import aligned
from tarn.llm.conversations import repaired
from tarn.llm.quality import of_quality, scored

SF = "/root/testdata/sf0.001"

# Conversation repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FAR = (10**9, "", ())


def damaged_brute(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        own = out[conv_id]
        harm = crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def repair_brute(rows):
    """Backward over rows: the least (cost, letters, lines) from each state on."""
    out = {}
    for conv_id, own in damaged_brute(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).hexdigest()))
        turns = [r[0] for r in own if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        after = {q: (0, "", ()) if q in ("", "a") else FAR for q in ("", "s", "u", "a")}
        for at in range(len(own), -1, -1):
            now = dict(after) if at == len(own) else {}
            for q in after if at < len(own) else ():
                extra, text = int(faults[at] == 3), own[at][2]
                ways = [("D", q, 3, ())]
                if faults[at] in (0, 3):
                    ways += [("K", NEXT[q, initials[at]], extra, (f"{own[at][1]}:{text}",))] if (q, initials[at]) in NEXT else []
                    ways += [("R", NEXT[q, r[0]], 2 + extra, (f"{r}:{text}",)) for r in ("user", "assistant") if (q, r[0]) in NEXT]
                now[q] = min((after[to][0] + c, letter + after[to][1], lines + after[to][2]) for letter, to, c, lines in ways)
            for _ in range(3):
                for q in now:
                    for role in ("user", "assistant"):
                        if (q, role[0]) in NEXT:
                            cost, letters, lines = now[NEXT[q, role[0]]]
                            now[q] = min(now[q], (cost + 2, "I" + letters, (role + ":", *lines)))
            after = now
        cost, audit, lines = after[""]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def chats(n, seed):
    """Conversation 7 holds most rows; nulls, odd roles, repeated rows, ties, blanks."""
    rng = random.Random(seed)
    roles = ["system", "tool", "", None, "Umpire", "sx"] + ["user", "assistant"] * 5
    texts = [None, "", " \n", "a.", "b", "why? ", "ça va!\n", "no", "ok.\n.", "第三。"] + [f"t{j}." for j in range(30)]
    rows = []
    for _ in range(n):
        conv_id = 7 if rng.random() < 0.5 else rng.choice([None, *range(60)])
        turn = rng.choice([None, *range(400)] if conv_id == 7 else [None, *range(-2, 9)])
        rows.append((conv_id, turn, rng.choice(roles), rng.choice(texts)))
    return rows + rows[:20]


CHAT = "conv_id long, turn long, role string, text string"


def found_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("n, seed", [(0, 0), (1, 1), (40, 2), (900, 3)])
def test_repair(spark, n, seed):
    rows = chats(n, seed) if n else []
    df = spark.createDataFrame(rows, CHAT).repartition(4).withColumns({c: F.lit(1) for c in ("part", "n", "fault", "first", "digest")})
    assert found_of(repaired(df)) == repair_brute(rows)


def test_repair_of_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 64)
    rows = [(5, t, ("user", "assistant", "system", "tool")[t * t % 7 % 4], f"text {t}" + "." * (t % 3)) for t in range(500)]
    found = repaired(spark.createDataFrame(rows, CHAT).repartition(3))
    assert found_of(found) == repair_brute(rows)


def test_repair_of_rows_all_alike(spark):
    rows = [(c, 3, "user", "again.") for c in (1, 2, 3) for _ in range(300)]
    assert found_of(repaired(spark.createDataFrame(rows, CHAT).repartition(5))) == repair_brute(rows)


def test_repair_of_a_long_text(spark):
    rows = [(1, 0, "user", "why? " * 400_000), (1, 1, "assistant", "so. " * 300_000), (1, 2, "user", "ok")]
    assert found_of(repaired(spark.createDataFrame(rows, CHAT))) == repair_brute(rows)


def test_cheapest_edits_of_all_short_conversations():
    """Every string of edits of up to three rows, priced one by one."""
    kinds = [(f, r) for f in range(4) for r in ("s", "u", "a", "")]
    rng = random.Random(4)
    for _ in range(300):
        own = [rng.choice(kinds) for _ in range(rng.randint(0, 3))]
        best = min(every_edit(own, 0, "", 0))
        done, _, whole = conversations.edits(own, (0, *[conversations.FAR] * 3), None, {0})
        assert (whole, "".join(x for x, _ in done)) == best


def every_edit(own, at, state, inserted):
    """(cost, letters) of all ways on; two inserts at a place are enough."""
    if at == len(own) and state in ("", "a"):
        yield 0, ""
    ways = [("I", r, 2, 0) for r in "ua"] if inserted < 2 else []
    if at < len(own):
        fault, role = own[at]
        ways.append(("D", None, 3, 1))
        if fault in (0, 3):
            ways += [("K", role, (fault == 3) * 1, 1)] + [("R", r, 2 + (fault == 3), 1) for r in "ua"]
    for letter, role, cost, step in ways:
        if role is None or (state, role) in NEXT:
            for more, letters in every_edit(own, at + step, state if role is None else NEXT[state, role], 0 if step else inserted + 1):
                yield cost + more, letter + letters


# Alignment


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_brute(tokenizers, text):
    """((id, start, end) of A, of B), or nothing."""
    a, b = tokenizers
    letters = alignment.byte_letters()
    if not text:
        return [], []
    sides = []
    own = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    for side in (own, [(i, piece_bytes(b, i)) for i in b.encode(text)]):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        ends = np.cumsum([len(x) for _, x in side]).tolist()
        sides.append([(i, end - len(x), end) for (i, x), end in zip(side, ends)])
    return sides


def piece_bytes(model, i):
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def aligned_brute(tokenizers, rows):
    counts, per = Counter(), []
    for doc_id, text in rows:
        a, b = tokens_brute(tokenizers, text)
        links, first = [], 0
        for j, s, e in b:
            while a[first][2] <= s:
                first += 1
            at = first
            while at < len(a) and a[at][1] < e:
                links.append((a[at][0], j))
                at += 1
        counts.update(links)
        groups, before = [], 0
        for end in sorted({x[2] for x in a} & {x[2] for x in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if before <= s and e <= end) for side in (a, b)) if len(a) < 400 else None)
            before = end
        digest = None if None in groups else sha256(";".join(groups).encode()).hexdigest() if a else ""
        per.append((doc_id, len(a), len(b), len(groups), links, digest))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (d, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for d, na, nb, ng, links, digest in per
    ]


def odd_texts():
    rng = random.Random(6)
    bits = [" ", "  ", "\n", "\t", "　", "a", "word", "don't", "1234", "é", "中文", "▁", "<|endoftext|>", "<s>", "<0x0A>", "..."]
    bits += ["\x00", "\xa0", "\u0085", "\x1c", "ﬁ", "\r\n", "é", "😀", "ß.", "Ω", "тест", ".", ","]
    fixed = [None, "", " ", "  ", " x", "x ", "x  ", "\n", "\n \n x", "a\n  b", "a\t\n\nb", "<unk>", "aaaaaaaaaaaaaaaaaaaa" * 9]
    return fixed + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]


@pytest.mark.parametrize("pairs, remembered, part", [(2_000_000, 400_000, 1 << 18), (300, 40, 1 << 18), (2_000_000, 400_000, 8)])
def test_alignment(spark, tokenizers, monkeypatch, pairs, remembered, part):
    """Also with several slices of pairs, with units forgotten, and texts in parts."""
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    texts = odd_texts()
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts + texts[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("links", "counts", "n_a", "best")})
    if remembered < 1000 or part < 1000:
        own = alignment.Aligner("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
        monkeypatch.setattr(alignment, "REMEMBERED", remembered)
        monkeypatch.setattr(alignment, "PART", part)
        want = {t: tokens_brute(tokenizers, t) for t in texts}
        for t in texts:
            counts = sum((own.counts[n].sum(axis=0) for n in own.read(t, own.prepared([t])[0])), np.zeros(4, np.int64))
            assert (counts[0], counts[1]) == tuple(map(len, want[t]))
            if own.full_up():
                own.thin_out()
    assert Counter(map(tuple, aligned(df.repartition(5)).collect())) == Counter(aligned_brute(tokenizers, rows))


def test_alignment_real(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in aligned(docs).collect()}
    for row in aligned_brute(tokenizers, [tuple(r) for r in docs.select("doc_id", "text").collect()]):
        assert got[row[0]][:7] == row[:7] and row[7] in (None, got[row[0]][7])


def test_alignment_of_no_rows_and_a_long_text(spark, tokenizers):
    schema = "doc_id long, text string"
    assert aligned(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "so it was. " * 40_000 + "x"), (2, "x")]
    got = {r[0]: tuple(r)[:7] for r in aligned(spark.createDataFrame(rows, schema)).collect()}
    assert got == {r[0]: r[:7] for r in aligned_brute(tokenizers, rows)}


# Quality


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in scored(docs, labels).collect()}
    assert len(rows) == docs.count()
    known = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect()]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r, _ in known)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())
    held = [(r["predicted"], q) for r, q in known if r["held_out"]]
    right = Counter(q for p, q in held if p == q)
    every = Counter(q for _, q in held)
    assert right[0] >= 0.9 * every[0] and right[1] >= 0.98 * every[1]


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "so " * 400_000), (None, "and so it was"), (5, "ab"), (5, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("good", "counts", "columns")})
    kinds = "doc_id long, quality int"
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (6, None), (7, 2), (5, 1), (5, 0)], kinds)
    got = [tuple(r) for r in scored(docs, labels).collect()]
    assert len(got) == 7 and all(0 <= r[2] <= 1 for r in got)
    assert len({r[2] for r in got if r[0] == 5}) == 1 and len({r[2] for r in got if r[0] in (1, 2)}) == 1
    assert sorted(map(str, (r["doc_id"] for r in of_quality(docs, labels).collect()))) == sorted(str(r[0]) for r in got if r[3])
    for marks, want in (([], 0.0), ([(3, 1), (4, 1)], 1.0)):
        assert {r["score"] for r in scored(docs, spark.createDataFrame(marks, kinds)).collect()} == {want}
    assert scored(docs.limit(0), labels).count() == 0


def test_votes_and_products_against_brute_force():
    rng = np.random.default_rng(3)
    vectors = np.rint(rng.standard_normal((60, 8)) * 300)
    good = (rng.random(60) < 0.4).astype(float)
    share = np.where(good == 1, 0.5 / good.sum(), 0.5 / (1 - good).sum())
    rows = np.concatenate((vectors[:5], np.zeros((1, 8)), np.rint(rng.standard_normal((20, 8)) * 300)))
    got = quality.votes(rows @ vectors.T, good, share)
    for row, vote in zip(rows, got):
        near = [sum(int(x) * int(y) for x, y in zip(row, v)) for v in vectors]
        last = sorted(near, reverse=True)[quality.NEIGHBOURS - 1]
        voters = [(p * s, g) for p, s, g in zip(near, share, good) if p >= last and p > 0]
        want = sum(w * g for w, g in voters) / sum(w for w, _ in voters) if voters else 0.5
        assert vote == pytest.approx(want, abs=1e-12)


def test_axes_are_the_singular_vectors():
    rows = np.random.default_rng(4).standard_normal((80, 30)) * np.linspace(3, 0.1, 30)
    axes = quality.singular_axes(rows, 5)
    _, _, want = np.linalg.svd(rows, full_matrices=False)
    assert np.abs(np.abs((axes * want[:5].T).sum(axis=0)) - 1).max() < 1e-3


def test_shapes_and_terms():
    own = quality.shapes(b"\nAb ab, x! x! 12\n")
    q = quality
    mark = {m: q.SHAPE[ord(m)] for m in ",!"}
    r = q.REPEATED
    assert own.tolist() == [q.LINE, q.UPPER, q.LOWER, q.BLANK, q.LOWER, mark[","], q.BLANK, r, q.BLANK, r, q.BLANK, q.DIGIT, q.LINE]
    text = "Çok güzel. " * 30
    assert q.term_counts(text.encode())[: q.BYTE_TERMS].sum() == len(text.encode()) + 2 - 2


# Passages of few different words


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 4, 7, 15, 30])
def test_passages_of_few_words_are_found_in_any_context(vocabulary):
    from tarn.llm.substring_dedup import chunks

    own = random.Random(vocabulary)
    for _ in range(150):
        known = ["".join(own.choice("abcdefgh") for _ in range(own.choice([1, 1, 2, 4, 7]))) for _ in range(vocabulary)]
        passage = [own.choice(known) for _ in range(own.randint(51, 100))]
        found = []
        for k in range(2):
            before, after = ([own.choice([*known, f"z{k}"]) for _ in range(own.randint(0, 40))] for _ in range(2))
            _, one, two, _, _, first, last = chunks([" ".join(before + passage + after).encode()], 20)
            found.append({(a, b): (f - len(before), z + 1 - len(before)) for a, b, f, z in zip(one.tolist(), two.tolist(), first.tolist(), last.tolist())})
        covered = np.zeros(len(passage), bool)
        for digest in found[0].keys() & found[1].keys():
            covered[max(0, found[0][digest][0]) : max(0, found[0][digest][1])] = True
        assert covered.sum() >= 25
