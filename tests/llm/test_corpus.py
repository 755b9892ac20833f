"""The corpus operators against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import toxicity as tox
from tarn.llm.common import word_count
from tarn.llm.components import components
from tarn.llm.exact_dedup import distinct_documents, exact_groups
from tarn.llm.knn import top_k
from tarn.llm.language import identified
from tarn.llm.mixing import mix, mixed_documents
from tarn.llm.near_dedup import near_groups, one_of_each_group
from tarn.llm.packing import pack, plan, sequences
from tarn.llm.registry import ORACLES, QUERIES
from tarn.llm.sharding import shard
from tarn.llm.substring_dedup import repeated_passages, without_repeats
from tarn.llm.toxicity import scored, without_toxic
from tarn.llm.url_filter import judged, propagated

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the caller.
CLASHES = ["size", "length", "node", "band", "word", "margin", "row_key", "rank", "label", "shard", "_id", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHES)

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abdegiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeats and copies."""
    base = [prose(60) for _ in range(6)]
    texts = [None, "", "   \n", "a", "a ", "one two three", "One  TWO three", "çà et là, où?", "ß\u2003Ω 中文 テスト"]
    texts += base + base[:3] + [b.replace(" ", "\t", 5) for b in base[:2]]
    texts += [b + " " + prose(2) for b in base] + [prose(3) + " " + b for b in base[:3]] + [prose(20000)]
    texts += [base[0]] * 12
    rows = []
    for i, text in enumerate(texts):
        rows.append((i * 3, text, None if i % 7 == 3 else ("en", "xx")[i % 2], None if i % 5 == 4 else f"s{i % 3}"))
    rows += [(None, "null id", "en", "s0"), (None, base[1], "en", None), rows[10], rows[10], (30, "other text of 30", "en", "s1")]
    return [r + (1,) * len(CLASHES) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


# packing


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def packing_holds(rows, texts, window):
    """``texts``: a list of (doc_id, text); ids may repeat with equal texts."""
    by_doc, filled = defaultdict(Counter), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id][(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        filled[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for doc_id, text in texts:
        ids = ids_of(text)
        for start in range(0, len(ids), window):
            part = ids[start : start + window]
            want[doc_id][(start, len(part), crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert by_doc == want
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(filled) == list(range(len(filled)))
    return len(filled)


def test_packing(docs, none):
    rows = pack(docs, 64).collect()
    packing_holds(rows, [(r.doc_id, r.text) for r in docs.collect()], 64)
    assert pack(none, 64).count() == 0


def test_packing_of_special_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "one.<|endoftext|>\n two  <|endoftext|>", "<|endoftext|", "中文 <|endoftext|>ß, end."]
    want = [untouched.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert [50256 in ids for ids in want] == [True, True, False, True]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64).collect()
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows} == {
        i: (len(ids), crc32(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(want)
    }


def test_packing_real(spark, documents):
    rows = QUERIES["op1_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    n = packing_holds(rows, texts, 1024)
    assert n <= 1.03 * sum(len(ids_of(t)) for _, t in texts) / 1024 + 1


def test_packed_sequences_round_trip(documents):
    some = documents.where("doc_id < 40")
    packed = pack(some, 256).cache()
    found = {r.sequence_id: r.ids for r in sequences(some, packed, 256).collect()}
    texts = {r.doc_id: ids_of(r.text) for r in some.collect()}
    for r in packed.collect():
        part = found[r.sequence_id][r.offset : r.offset + r.length]
        assert part == texts[r.doc_id][r.start : r.start + r.length]


def test_packed_sequences_of_odd_rows(docs, none):
    some = docs.union(docs.where("doc_id % 2 = 0"))
    packed = pack(some, 64).cache()
    found = {r.sequence_id: r.ids for r in sequences(some, packed, 64).collect()}
    assert set(found) == {r.sequence_id for r in packed.select("sequence_id").distinct().collect()}
    for r in packed.collect():
        part = found[r.sequence_id][r.offset : r.offset + r.length]
        assert len(part) == r.length and crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert sequences(none, pack(none, 64), 64).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_solve_comes_close_to_the_least_squares(seed):
    from tarn.llm.packing import solve

    r = random.Random(seed)
    combos = [(40, 24), (30, 20, 14), (32, 32), (50, 14), (24, 20, 20)]
    counts = {x: r.randint(5, 200) for x in (14, 20, 24, 30, 32, 40, 50)}
    lengths = sorted(counts)
    a = np.array([[c.count(x) for c in combos] for x in lengths], float)
    b = np.array([counts[x] for x in lengths], float)
    best = np.inf  # brute force: the least squares of every set of combinations that comes out non-negative
    for mask in range(1, 1 << len(combos)):
        own = [j for j in range(len(combos)) if mask >> j & 1]
        x = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
        if (x >= -1e-9).all():
            best = min(best, float(((a[:, own] @ x - b) ** 2).sum()))
    x = solve(combos, counts)
    assert (x >= 0).all() and float(((a @ x - b) ** 2).sum()) <= 1.01 * best + 5


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    counts = Counter(min(64, int(r.expovariate(0.05)) + 1) for _ in range(3000))
    used = Counter()
    for combo, n in plan(dict(counts), 64):
        assert sum(combo) <= 64 and n > 0
        for length in combo:
            used[length] += n
    assert used == counts


# exact and near duplicates


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[bare(r.text)].append(r)
    out = Counter()
    for key, own in groups.items():
        best = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is not None, r.doc_id or 0))
        sha = hashlib.sha256(key.encode()).hexdigest()
        for r in own:
            out[(r.doc_id, best.doc_id, len(own), r.doc_id == best.doc_id, sha)] += 1
    return out


def test_exact_dedup(docs, none):
    found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs).collect())
    assert found == exact_brute(docs.collect())
    assert exact_groups(none).count() == 0


@pytest.mark.parametrize("size", [1, 2])
def test_exact_dedup_with_clashing_digests(docs, size):
    found = Counter(
        (r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, digest_bytes=size).collect()
    )
    assert found == exact_brute(docs.collect())


def test_distinct_documents(docs):
    out = distinct_documents(docs)
    assert out.columns == docs.columns
    kept = Counter(bare(r.text) for r in out.collect())
    assert kept == {bare(r.text): 1 for r in docs.collect()}


def shingles(text, width=5):
    w = [re.sub("[A-Z]+", lambda m: m.group().lower(), x) for x in words(text)]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def near_brute(rows):
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = root(i)
        if r.doc_id is not None:
            least[key] = min(least.get(key, r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), least.get(root(i)), r.doc_id == least.get(root(i))) for i, r in enumerate(rows))


def test_near_dedup(docs, none):
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(docs).collect())
    assert found == near_brute(docs.collect())
    assert near_groups(none).count() == 0


def test_near_dedup_real(spark, documents):
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op3_minhash_near_dedup"](spark, SF).collect())
    assert found == near_brute(documents.collect())


@pytest.mark.parametrize("worthwhile, block", [(1.0, 3), (1.0, 1024), (0.2, 16)])
def test_near_dedup_in_blocks(spark, monkeypatch, worthwhile, block):
    from tarn.llm import near_dedup

    monkeypatch.setattr(near_dedup, "WORTHWHILE", worthwhile)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(8)
    rows = []
    for g in range(4):  # groups whose members are about as alike as the bound
        base = [r.choice(VOCABULARY) for _ in range(120)]
        for k in range((5, 25, 40, 70)[g]):
            own = list(base)
            for _ in range(r.randint(1, 5)):
                own[r.randrange(120)] = f"x{r.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_groups(table).collect())
    assert found == near_brute(table.collect())


def test_common_counts():
    from tarn.llm.near_dedup import common_counts

    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 9000, r.integers(1, 6000)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert common_counts(sets, 4).tolist() == want


def test_one_of_each_group(documents):
    keep = {r.doc_id for r in near_groups(documents).where("kept").collect()}
    out = one_of_each_group(documents)
    assert out.columns == documents.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(keep)


def test_one_of_each_group_of_odd_rows(docs, none):
    rows = docs.collect()
    want = near_brute(rows)
    groups = {(i, n) for (i, n, c, kept) in want if n and (kept or (i is None and c is None))}
    out = one_of_each_group(docs).collect()
    assert len({r.doc_id for r in out if shingles(r.text)}) == len({i for i, _ in groups})
    assert Counter((r.doc_id, r.text) for r in out if not shingles(r.text)) == Counter(
        {(r.doc_id, r.text) for r in rows if not shingles(r.text)}
    )
    assert one_of_each_group(none).count() == 0 and distinct_documents(none).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    from tarn.llm import text_bytes

    long = (prose(3000) + "  " + "x" * 700 + "\n" + prose(50)).encode()
    whole, hits = text_bytes.shingle_sets([long], 5)[0], text_bytes.gear_hits(long, 5)
    monkeypatch.setattr(text_bytes, "SLICE", 512)
    assert (text_bytes.shingle_sets([long], 5)[0] == whole).all()
    assert (text_bytes.gear_hits(long, 5) == hits).all()


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    label = {n: n for p in pairs for n in p}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = {x.node: x.label for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {n: x for n, x in label.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# repeated passages


def test_repeated_passages(spark, none):
    shared = prose(60)
    texts = [prose(80) + " " + shared + " " + prose(70), shared, prose(200), "Ünï " * 3 + shared + "\n" + prose(40), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = repeated_passages(docs).collect()
    assert {r.doc_id for r in rows} == {0, 1, 3}
    for r in rows:
        span = texts[r.doc_id].encode()[r.start : r.start + r.length].decode()
        assert span in shared and len(words(span)) == r.n_words >= 25
        assert r.kept == (r.doc_id == 0) and r.first_doc_id == 0
    assert repeated_passages(none).count() == 0
    cleaned = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert cleaned[0] == texts[0] and cleaned[2] == texts[2] and cleaned[4] is None
    assert len(words(cleaned[1])) <= 23
    out = without_repeats(none)
    assert out.columns == none.columns and out.count() == 0


def test_repeated_passages_of_odd_rows(docs):
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    rows = repeated_passages(docs).collect()
    assert any(r.doc_id is None for r in rows) and all(r.first_doc_id in texts for r in rows)
    for r in rows:
        spans = {(t or "").encode()[r.start : r.start + r.length].decode("utf-8", "ignore") for t in texts[r.doc_id]}
        assert any(s and sum(any(s in (t or "") for t in own) for own in texts.values()) > 1 for s in spans) or r.doc_id is None
        assert r.doc_id is not None or not r.kept
    assert without_repeats(docs).count() == docs.count()


def repeats_brute(texts, least):
    """Places (doc, word) in a run of ``least`` words that another document holds."""
    where = defaultdict(set)
    for i, t in texts.items():
        w = words(t)
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add((i, k))
    out = set()
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            out |= {(i, k) for i, k in places}
    return out


def test_repeated_passages_against_brute_force(spark, documents):
    texts = {r.doc_id: " ".join(words(r.text)) for r in documents.collect()}
    plain = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    covered = defaultdict(list)
    for r in repeated_passages(plain).collect():
        data = texts[r.doc_id].encode()
        first = len(words(data[: r.start].decode()))
        covered[r.doc_id].append((first, first + r.n_words))
        assert r.first_doc_id <= r.doc_id and (r.first_doc_id == r.doc_id) == r.kept
    for i, k in repeats_brute(texts, 51):  # of every repeat of 51 words, 28 or more are in spans
        held = {w for a, b in covered[i] for w in range(max(a, k), min(b, k + 51))}
        assert len(held) >= 25, (i, k)
    repeated = repeats_brute(texts, 20)
    for i, spans in covered.items():  # and no word is in a span that no repeat of a chunk's length holds
        words_in = {k + j for d, k in repeated if d == i for j in range(20)}
        assert all(w in words_in for a, b in spans for w in range(a, b))


def test_long_texts_are_chunked_in_parts(spark, monkeypatch):
    from tarn.llm import substring_dedup

    text = prose(3000).encode()
    every = lambda found: set(zip(*(x.tolist() for x in found[1:])))
    whole = every(substring_dedup.chunks([text], 20))
    monkeypatch.setattr(substring_dedup, "SLICE", 4000)
    some = set()
    for byte, word, part in substring_dedup.overlapping(text):
        _, one, two, start, end, first, last = substring_dedup.chunks([part], 20)
        some |= every((one, one, two, start + byte, end + byte, first + word, last + word))
    assert whole <= some


def test_passages_of_just_over_50_words_are_found_in_any_context(spark):
    own = random.Random(11)
    plain = lambda n, most: " ".join("".join(own.choice("abdegiklmnoprstu") for _ in range(own.randint(1, most))) for _ in range(n))
    rows = []
    for i in range(2000):
        most = (2, 4, 7, 10)[i % 4]
        passage = plain(own.randint(51, 60), most)
        rows.append((2 * i, plain(own.randint(0, 60), most) + "\n" + passage + " " + plain(40, most), passage))
        rows.append((2 * i + 1, plain(own.randint(0, 90), most) + " " + passage + "\t" + plain(20, most), passage))
    df = spark.createDataFrame(rows, "doc_id long, text string, passage string")
    found = Counter()
    for r in repeated_passages(df.select("doc_id", "text")).collect():
        span = rows[r.doc_id][1].encode()[r.start : r.start + r.length].decode()
        assert span in rows[r.doc_id][2] and len(words(span)) == r.n_words >= 25
        found[r.doc_id] += 1
    assert found == Counter(range(4000))


def test_passages_in_the_first_of_a_group_of_copies_are_cut(spark):
    shared, own, other = prose(60), prose(80), prose(70)
    texts = {2: prose(50) + " " + shared + " " + prose(40), 5: own + " " + shared + " " + other}
    texts[9] = texts[5]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sorted(repeated_passages(docs).collect())
    assert [(r.doc_id, r.kept, r.first_doc_id) for r in rows] == [
        (2, True, 2), (5, True, 5), (5, False, 2), (5, True, 5), (9, False, 5),
    ]
    for r in rows[1:4]:
        span = texts[5].encode()[r.start : r.start + r.length].decode()
        assert len(words(span)) == r.n_words and (r.kept or (span in shared and r.n_words >= 37))
    assert rows[1].start + rows[1].length <= rows[2].start and rows[2].start + rows[2].length <= rows[3].start
    cleaned = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert cleaned[2] == texts[2] and own in cleaned[5] and other in cleaned[5]
    assert len(words(cleaned[5])) <= 80 + 70 + 23 and len(words(cleaned[9])) <= 23


def test_texts_of_a_short_period_repeat(spark):
    texts = ["ha " * 400, "ha " * 300, "0 1 " * 200, prose(20) + " " + "0 1 " * 100]
    rows = repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.kept) for r in rows) == {(0, True): 1, (1, False): 1, (2, True): 1, (3, False): 1}
    assert all(r.n_words >= 186 for r in rows)


# mixing


def target_brute(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def mixing_holds(rows, docs, slack):
    texts = Counter((r.doc_id, len(words(r.text))) for r in docs)
    assert Counter((r.doc_id, r.size) for r in rows) == texts
    sizes, taken = Counter(), Counter()
    for r in docs:
        sizes[r.source] += len(words(r.text))
    target = target_brute(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= slack(s), (s, taken[s], t)


def test_mixing(docs, none):
    rows = docs.collect()
    most = defaultdict(int)
    for r in rows:
        most[r.source] = max(most[r.source], len(words(r.text)))
    mixing_holds(mix(docs).collect(), rows, lambda s: most[s])
    assert mix(none).count() == 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns and mixed_documents(none).count() == 0


def test_mixing_real(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op5_pareto_mixing"](spark, sf).collect()
    own = documents.collect()
    sizes = Counter()
    for r in own:
        sizes[r.source] += len(words(r.text))
    mixing_holds(rows, own, lambda s: 0.01 * sizes[s])
    assert sorted(rows) == sorted(QUERIES["op5_pareto_mixing"](spark, sf).collect())
    taken = {r.doc_id: r.copies for r in rows if r.taken}
    for s in sizes:  # what is due makes up the target, by the classes of the weights
        assert sum(r.due * r.size for r in rows if r.source == s) == pytest.approx(next(r.target for r in rows if r.source == s), rel=0.02)
    assert all(int(r.due) <= r.copies <= min(2, int(r.due) + 1) for r in rows if r.size)
    assert Counter(r.doc_id for r in mixed_documents(documents).collect()) == taken


def due_brute(sizes, target, most=2.0):
    """Copies due, in proportion to the root of the size, by bisection."""
    low, high = 0.0, most
    for _ in range(200):
        level = (low + high) / 2
        if sum(s * min(most, level * s**0.5) for s in sizes) < target:
            low = level
        else:
            high = level
    return [min(most, low * s**0.5) for s in sizes]


def test_inclusion_follows_what_is_due(spark):
    r = random.Random(12)
    sizes = [r.choice((4, 25, 100, 400)) for _ in range(6000)]
    df = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    for percent in (60, 150):
        rows = {x.doc_id: x for x in mix(df, percent=percent).collect()}
        due = due_brute(sizes, sum(sizes) * percent / 100)
        assert [rows[i].due for i in range(6000)] == pytest.approx(due, rel=0.02)
        for size in set(sizes):
            own = [i for i, s in enumerate(sizes) if s == size]
            p = due[own[0]] % 1
            spread = 4 * (p * (1 - p) / len(own)) ** 0.5 + 0.02
            assert sum(rows[i].copies for i in own) / len(own) == pytest.approx(due[own[0]], abs=spread)
        assert abs(sum(x.taken for x in rows.values()) - sum(sizes) * percent / 100) < 4


def test_mixed_copies_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s", i) for i in range(7)] + [(2, None, "s", 7)], "doc_id long, text string, source string, mark int")
    for percent in (50, 150):
        taken = sum(x.copies for x in mix(df, percent=percent).where("size > 0").collect())
        out = Counter(x.mark for x in mixed_documents(df, percent=percent).collect())
        assert sum(out.values()) == taken and all(n <= 2 for n in out.values()) and max(out.values()) - min(out[i] for i in range(7)) <= 1


def test_word_count(spark):
    texts = [None, "", " ", "a", " a b\u2003c\td ", "\x0b\x0cx\r\ny"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n")).collect()
    assert all(r.n == len(words(r.t)) for r in rows)


# languages and toxicity


def test_language(spark, documents, docs, none):
    rows = QUERIES["op6_language"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    odd = identified(docs).collect()
    assert len(odd) == docs.count()
    by_id = {r.doc_id: r for r in odd}
    assert by_id[0].lang_pred == by_id[3].lang_pred == by_id[6].lang_pred == "und" and not by_id[None].held_out
    assert {r.lang_pred for r in odd} <= {"en", "xx", "und"}
    assert identified(none).count() == 0


def rank_brute(text, most=300):
    """The n-grams of a text by count, then code."""
    joined = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if g != " " and (n < 3 or g[1] != " "):
                grams[g] += 1
    code = lambda g: sum(ord(c) << (21 * i) for i, c in enumerate(reversed(g)))
    return [code(g) for g in sorted(grams, key=lambda g: (-grams[g], code(g)))][:most]


def test_ranked_grams(monkeypatch):
    from tarn.llm import language

    for text in ("The cat. The dog's 2 cats!", "été à la plage", prose(300)):
        assert language.ranked(text, 300).tolist() == rank_brute(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert language.ranked("The cat and the dog ate the cake", 300).tolist() == rank_brute("The cat and the dog ate the cake")


def kernel_brute(s, t):
    """``s`` and ``t``: letters in their places, a blank for a gap."""

    def subsequences(w):
        out = Counter()
        n = len(w)
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + tox.SPAN)):
                    if " " not in (w[i], w[j], w[k]):
                        out[w[i] + w[j] + w[k]] += tox.DECAY ** (k - i + 1)
        return out

    a, b = subsequences(s), subsequences(t)
    return sum(a[u] * b[u] for u in a)


def strings_brute(text):
    """Windows from each word's start, by a plain reading of the rule."""
    out = []
    for sentence in re.split(r"\n|[.!?](?=\s)", text.lower() + "\n"):
        row = []
        for word in ("".join(c for c in w if c.isalpha()) for w in sentence.split()):
            if word:
                row += [word] if not (row and len(word) == 1 and row[-1][-1:].isalpha() and alone) else []
                if row[-1] is not word:
                    row[-1] += word
                alone = len(word) == 1
        line = " ".join(row)
        at = 0
        for word in row:
            out.append(line[at : at + tox.WIDTH].ljust(tox.WIDTH))
            at += len(word) + 1
    return out


def test_string_kernel(monkeypatch):
    texts = ["You id-i.ot and a w o r t h l e s s x.  Next one! b c\nÄb ß", "", "... 12", "mississippi is long. a"]
    letters, starts, owners = tox.spelled(texts)
    rows = tox.strings(letters, starts)
    spell = lambda row: "".join(" " if not c else chr(96 + c) if c < 27 else "?" for c in row)
    want = [(i, re.sub(r"[^a-z ]", "?", s)) for i, t in enumerate(texts) for s in strings_brute(t)]
    assert list(zip(owners.tolist(), map(spell, rows))) == want
    plain = [spell(r).replace("?", "#") for r in rows]
    keep = [i for i, s in enumerate(plain) if "#" not in s]
    got = tox.kernel(rows[keep], rows[keep[:4]])
    for i, a in enumerate(keep):
        for j, b in enumerate(keep[:4]):
            assert got[i, j] == pytest.approx(kernel_brute(plain[a], plain[b]), abs=1e-4)
    vector = np.random.default_rng(1).normal(size=tox.CODES).astype(np.float32)
    vector[[c for c in range(tox.CODES) if not (c & 63 and c >> 6 & 63 and c >> 12)]] = 0
    brute = [sum(d * vector[codes[k]] for d, codes in tox.subsequences(rows)) for k in range(len(rows))]
    assert tox.margins(letters, starts, vector) == pytest.approx(brute, abs=1e-3)
    # A document's margin is its highest string's; long texts are scored in portions.
    long = prose(2000)
    best = [max((b for b, o in zip(brute, owners) if o == i), default=0.0) + 0.5 for i in range(4)]
    best.append(tox.document_margins([long], vector, 0.5)[0])
    monkeypatch.setattr(tox, "SLICE", 3000)
    assert tox.document_margins([*texts, long], vector, 0.5) == pytest.approx(best, abs=1e-3)
    owner, top = tox.hardest_strings(texts, vector, 1)
    assert [bytes(t) for t in top] == [max((b, bytes(r)) for b, r, o in zip(brute, rows, owners) if o == i)[1] for i in owner]


def test_toxicity_learns_in_spite_of_wrong_labels(spark):
    docs, labels = insulted(spark)
    wrong = labels.withColumn("toxic", F.when(F.col("doc_id").isin(1, 2, 3), 1).when(F.col("doc_id").isin(4, 8, 12), 0).otherwise(F.col("toxic")))
    found = {r.doc_id: r.predicted for r in scored(docs, wrong).collect()}
    held = [i for i in range(500) if crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)


def insulted(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        w = [r.choice(VOCABULARY) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(60), r.choice(["idiotic", "worthless", "dumbhead"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    for k, bad in enumerate(["id.iot.ic", "w o r t h l e s s", "worxthless", "dumb-head"]):
        rows.append((1000 + k, prose(30) + f" {bad} " + prose(30)))
    rows += [(2000, None), (2001, ""), (None, "an id less row"), (2002, prose(60)), (2003, prose(5000))]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_disguised_insults(spark, none):
    docs, labels = insulted(spark)
    found = {r.doc_id: r for r in scored(docs, labels).collect()}
    assert len(found) == docs.count()
    held = [i for i in range(500) if crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out for i in held)
    assert sum(found[i].predicted == int(i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert [found[1000 + k].predicted for k in range(4)] == [1] * 4
    assert all(found[i].predicted == 0 and 0 <= found[i].score <= 1 for i in (2000, 2001, None, 2002, 2003))
    left = without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in found.items() if not r.predicted}
    assert scored(none, labels).count() == 0 and without_toxic(none, labels).columns == none.columns
    odd = labels.selectExpr("doc_id", "toxic", "'x' AS text", "1 AS score").union(
        spark.createDataFrame([(1, None, "", 1), (2, 7, "", 1), (None, 1, "", 1)], "doc_id long, toxic int, text string, score int")
    )
    again = {r.doc_id: r.score for r in scored(docs, odd).collect()}
    assert again == pytest.approx({i: r.score for i, r in found.items()})


def test_toxicity_without_labels(docs, spark):
    rows = scored(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(rows) == docs.count() and not any(r.predicted for r in rows)


# exact search


def test_top_k_over_many_cells(spark, monkeypatch):
    """Clusters, repeated rows and ties, in shards of 16 and blocks of 4, against all pairs."""
    monkeypatch.setattr("tarn.llm.knn.SHARD", 16)
    monkeypatch.setattr("tarn.llm.knn.BLOCK", 4)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=5) * 0.1]) for i in range(600)]
    rows += [(7, [0.5] * 5)] * 60 + [(1000 + i, [0.25 * (i % 3), 0.5]) for i in range(90)] + [(2000, []), (2050, [])]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = Counter()
    for q, vector in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q and len(v) == len(vector))
            want.update((q, rank + 1, i, -minus) for rank, (minus, i) in enumerate(scored[:5]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, top_k(df.repartition(5)).collect())) == want


def test_top_k(spark):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], 1) for i in range(300)]
    rows += [(300, None, 1), (301, [None] * 6, 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (304, [1.0, 2.0], 1), (None, [0.5] * 6, 1)]
    rows += [rows[5], rows[50], (306, rows[5][1], 1), (400, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    usable = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, x in {i: v for i, v in usable if i % 50 == 0}.items():
        scores = sorted((-int(x @ y), i) for i, y in usable if i != q and len(x) == len(y))[:5]
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scores))
    assert Counter(map(tuple, top_k(df).collect())) == want
    assert top_k(df.limit(0)).count() == 0


# shards


def test_sharding(docs, none):
    rows = shard(docs, 16).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    tokens = Counter((r.doc_id, len(ids_of(r.text)) - 1) for r in docs.collect())
    assert Counter((r.doc_id, r.tokens) for r in rows) == tokens
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(none, 16).count() == 0


def test_sharding_real(spark):
    sizes, tokens, rows = Counter(), Counter(), Counter()
    for r in QUERIES["op9_vector_sharding"](spark, "/root/testdata/sf0.01").collect():
        sizes[r.shard] += r.size
        tokens[r.shard] += r.tokens
        rows[r.shard] += 1
    assert len(sizes) == 16 and max(sizes.values()) <= 1.02 * min(sizes.values())
    for other in (tokens, rows):
        assert max(other.values()) <= 1.1 * min(other.values())


def test_placing_takes_the_shard_with_the_best_product():
    from tarn.llm.sharding import EMPHASIS, place

    items = np.random.default_rng(3).integers(1, 50, (60, 3)).astype(float)
    found = place(items, 4)
    shares = items / items.sum(0)
    residual = np.full((4, 3), 0.25)
    for i in sorted(range(60), key=lambda i: (-items[i, 0], -shares[i].sum(), i)):
        products = [sum(EMPHASIS[d] * residual[s, d] * shares[i, d] for d in range(3)) for s in range(4)]
        assert products[found[i]] == pytest.approx(max(products))
        residual[found[i]] -= shares[i]


# urls


def test_urls(spark):
    urls = [
        "http://www.Example.com/en/a?x#y", "https://example.com/en/", "ftp://a.example.com/EN/", "http://x.net/es/", "http://net/fr/q",
        "http://x.net/de/", "http://xcom/", "a://b://c/d", "://", "nothing", None, "", "http://host?q=/es/", "http://h.com", "http://b.example.com/en/z",
    ]
    df = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(df).collect()}
    assert got[0] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("a.example.com", "/EN/", "com/", "allow")
    assert got[3] == ("x.net", "/es/", "net/es/", "block")
    assert got[4] == ("net", "/fr/q", "net/fr/", "block")
    assert got[5][:3] == ("x.net", "/de/", None)
    assert got[6][:3] == ("xcom", "/", None)
    assert got[7][:3] == ("b:", "//c/d", None)
    assert got[8] == got[9] == got[10] == got[11] == ("", "", None, "allow")
    assert got[12][:3] == ("host", "", None)
    assert got[13][:3] == ("h.com", "", None)
    assert got[14][2] == "example.com/en/"
    assert judged(df.limit(0)).count() == 0


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<a href="{x}">x</a>' for x in links))
    rows = [
        page(0, "http://bad.net/es/"), page(1, "http://farm.org/", "http://bad.net/x"), page(2, "http://good.com/", "http://friend.org/"),
        page(3, "http://friend.org/"), page(4, "http://alone.org/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in judged(df).collect()}
    assert got[1].verdict == "block" and got[1].distrust > 0
    assert got[3].verdict == "allow" and got[3].trust > 0
    assert got[4].verdict == "allow" and got[4].trust == got[4].distrust == 0


def test_distrust_reaches_the_end_of_a_chain(spark):
    hosts = ["bad.net", *(f"h{i}.org" for i in range(1, 17))]
    link = lambda i: f'<a href="http://{hosts[i - 1]}/">x</a>' if i else ""
    rows = [(i, f"http://{h}/es/", link(i)) for i, h in enumerate(hosts)]
    got = {r.page_id: r for r in judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(17):
        assert got[i].verdict == "block" and got[i].distrust == pytest.approx(0.15 * 0.85**i / (1 - 0.85**17))


def test_trust_in_a_circle_comes_close_to_the_limit(spark):
    seeds = spark.createDataFrame([("a", 1.0)], "host string, mass double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    got = dict(propagated(seeds, edges, tolerance=0.01).collect())
    assert got == pytest.approx({"a": 0.15 / (1 - 0.85**2), "b": 0.15 * 0.85 / (1 - 0.85**2)}, abs=0.01)


@pytest.mark.parametrize("seed", range(2))
def test_trust_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    n = 14
    links = (r.random((n, n)) < 0.15) & ~np.eye(n, dtype=bool)
    links[3] = links[7] = False  # hosts without links
    mass = np.zeros(n)
    mass[[1, 5]] = 0.25, 0.75
    step = np.where(links.any(1)[:, None], links / np.maximum(1, links.sum(1))[:, None], mass)
    want = mass.copy()
    for _ in range(400):
        want = 0.15 * mass + 0.85 * want @ step
    edges = [(f"h{i}", f"h{j}", float(1.0 / links[i].sum())) for i in range(n) for j in range(n) if links[i, j]]
    seeds = spark.createDataFrame([("h1", 0.25), ("h5", 0.75)], "host string, mass double")
    got = dict(propagated(seeds, spark.createDataFrame(edges, "src string, dst string, weight double")).collect())
    assert [got.get(f"h{i}", 0.0) for i in range(n)] == pytest.approx(want.tolist(), abs=1e-5)


# pipeline and oracles


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, state = None, docs
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        state = stage(spark, state, SF).cache()
        if name == "exact_dedup":
            assert len({bare(r.text) for r in before}) == state.count() == len({bare(r.text) for r in state.collect()})
        if name == "near_dedup":
            want = {k[0] for k in near_brute(before) if k[3]}
            assert {r.doc_id for r in state.collect()} == want
        if name == "mixing":
            assert {r.doc_id for r in state.collect()} <= {r.doc_id for r in before}
        if name == "packing":
            packing_holds(state.collect(), [(r.doc_id, r.text) for r in before], 1024)
        else:
            assert state.columns == docs.columns
            kept = state
    assert kept.count() > 0


def test_pipeline_stages_on_odd_rows(spark, docs, none):
    import corpus_pipeline

    state, empty = docs, none
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        state, empty = stage(spark, state, SF).cache(), stage(spark, empty, SF)
        assert empty.count() == 0
        if name == "packing":
            packing_holds(state.collect(), [(r.doc_id, r.text) for r in before], 1024)
        else:
            assert state.columns == empty.columns == docs.columns
        if name == "toxicity":
            assert {r.doc_id for r in before if not r.text} <= {r.doc_id for r in state.collect()}
        if name == "exact_dedup":
            assert Counter(bare(r.text) for r in state.collect()) == dict.fromkeys((bare(r.text) for r in before), 1)
        if name == "near_dedup":
            groups = {k[2] for k in near_brute(before) if k[1]}
            assert len([r for r in state.collect() if shingles(r.text)]) == len(groups)
        if name == "mixing":
            assert all(words(r.text) for r in state.collect()) and state.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.sql(ORACLES[name]).select(*columns).fetchall()
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(want)
