"""Manifest, collocations and packing against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm_operators import AWKWARD, awkward, documents, prose
from tidemark.llm import encoding, merkle, packing, phrases
from tidemark.llm.queries import tokenizer_path


# --- manifest --------------------------------------------------------------------------
def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """(root, siblings of each leaf from below) of runs of three."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, leaves in enumerate(owners):
            run = nodes[i - i % 3:i - i % 3 + 3]
            for leaf in leaves:
                paths[leaf].append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
        nodes = [digest("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        owners = [sum(owners[i:i + 3], []) for i in range(0, len(owners), 3)]
    return nodes[0], paths


def brute_manifest(rows, judge) -> Counter:
    groups = defaultdict(list)
    for r in rows:
        leaf, shown = (digest("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))))
                       for t in (r.text, judge(r)))
        groups[r.source].append((r.doc_id is None, r.doc_id or 0, leaf, shown))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    root, above = climb([trees[s][0] for s in order])
    out = Counter()
    for s, up in zip(order, above):
        for (unknown, doc_id, leaf, shown), path in zip(sorted(groups[s]), trees[s][1]):
            proof = digest("".join(x for _, rest in [*path, *up] for x in rest))
            value = shown
            for place, rest in [*path, *up]:
                value = digest("".join([*rest[:place], value, *rest[place:]]))
            out[None if unknown else doc_id, leaf, trees[s][0], root, proof, value, value == root] += 1
    return out


def no_breaks(r):
    return r.text.replace("\n", "") if r.text and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_brute_force(spark, height):
    docs = awkward(spark).unionByName(documents(spark, [prose(i, 5) + "\n" for i in range(60)], 100))
    docs = docs.withColumn("source", F.when(F.col("doc_id") > 110, "hot").otherwise(F.col("source")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.manifest(docs, height=height, judged={"text": F.when(
        tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    assert Counter(map(tuple, got.collect())) == brute_manifest(docs.collect(), no_breaks)


def test_manifest_of_nothing_and_one_row(spark):
    assert merkle.manifest(documents(spark, [])).count() == 0
    docs = documents(spark, ["alone"])
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == digest("")


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_addresses_fill_the_layout(arity):
    for levels in range(1, 7):
        places = np.concatenate([merkle.addresses(levels, d, np.arange(arity ** d), arity) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(merkle.size(levels, arity)))
        assert places[0] == 0
    # a lower subtree is contiguous
    top = 5 // 2
    below = np.concatenate([merkle.addresses(5, top + d, np.arange(arity ** d), arity) for d in range(5 - top)])
    assert below.max() - below.min() == len(below) - 1


def test_other_arities_fold_back(spark):
    docs = documents(spark, [prose(i, 4) for i in range(40)])
    got = merkle.manifest(docs, height=2, arity=2).collect()
    assert all(r.verified for r in got) and len({r.root for r in got}) == 1


# --- collocations ----------------------------------------------------------------------
def brute_phrases(rows, support, longest, best):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        big = [p for p in f if 2 <= len(p) and f[p] >= support]
        for p in big:
            score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and f[q] >= f[p] and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q in big)
            if not inside:
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mixed_languages(spark):
    draw = random.Random(5)
    common = ["of the", "New York City", "à la carte", "a b a b a"]
    rows = []
    for i in range(300):
        words = [draw.choice(common) if draw.random() < 0.4 else f"w{draw.randrange(30)}" for _ in range(40)]
        text = "".join(w + draw.choice([" ", "  ", "\t", ". ", "\n", ", "]) for w in words)
        rows.append((i, text, draw.choice(["en", "fr", None, "und"])))
    rows += [(1000 + i, t, "en") for i, t in enumerate(AWKWARD)] + [(None, "of the of the", "xx"), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("phrase", F.lit(1))


@pytest.mark.parametrize("support, shard", [(20, 1 << 25), (20, 3_000), (5, 500), (1000, 100)])
def test_collocations_equal_brute_force(spark, support, shard):
    docs = mixed_languages(spark).repartition(3).cache()
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = phrases.collocations(docs, support=support, best=25, shard=shard).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, support, 5, 25)


def test_many_shards_send_what_may_be_frequent_in_the_corpus(spark, monkeypatch):
    """With a lowered support of one, phrases of infrequent parts are not sent."""
    rows = [(i, " ".join(["of the sea", *(f"w{i}x{k}" for k in range(60))]), "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    words, sent, plain = 120 * 63, [], type(docs).mapInArrow

    def counted(df, function, schema):
        out = plain(df, function, schema)
        if not schema.startswith("part"):  # the filter's own bits
            sent.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    found, totals = phrases.frequent_phrases(docs, support=50, shard=500)
    assert {(r.phrase, r.words, r.f) for r in found.collect()} == {
        ("of", 1, 120), ("the", 1, 120), ("sea", 1, 120), ("of the", 2, 120), ("the sea", 2, 120), ("of the sea", 3, 120)}
    assert [tuple(r) for r in totals.collect()] == [("en", words)]
    assert sum(sent) < 3 * words


def test_collocations_of_nothing(spark):
    docs = mixed_languages(spark)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(3 * big).alias("n"), F.lit(7 * big).alias("l"),
                                F.lit(big + 1).alias("r")).select(phrases.score("a", "n", "l", "r").alias("s")).first()
    assert row.s == 1000 * big * 3 * big // (7 * big * (big + 1))


def test_filter_lets_every_candidate_through(spark):
    hashes = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 50_000)
    table = spark.createDataFrame([(int(h),) for h in hashes], "hash long")
    for limit in (phrases.FILTER_BITS, phrases.PART_BITS):
        bitmap = phrases.bloom_filter(table, limit)
        bits = len(bitmap) * 8
        at = phrases.places(hashes.view(np.uint64), bits)
        assert (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all()


# --- encoding and packing --------------------------------------------------------------
def test_batches_equal_single_texts():
    code, draw = encoding.Encoder(tokenizer_path()), random.Random(3)
    signs = [*"ab Cz  \n\t\r.,;'s!?-_019tlldrev", *map(chr, (
        0xE9, 0xDF, 0x201C, 0x2026, 0x65E5, 0, 0x1F, 0x1F642, 11, 12, 0xD7, 0xF7, 0x85, 0xA0, 0x2003, 0x3000, 0x100,
        0x200, 0x250, 0x301))]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(50))) for _ in range(4000)]
    texts += [*AWKWARD, "x <|endoftext|> y  z", "a" * 70_000, " " * 5_000 + "a", "'tis don't we'LL they'll"]
    for text, ids in zip(texts, code.encoded(pa.array(texts))):
        assert ids.tolist() == code.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def check_packing(rows, texts, tiers, end_id=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    assert sorted(windows) == list(range(len(windows)))
    padded = 0
    for inside in windows.values():
        at = 0
        for r in sorted(inside, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and r.tier == inside[0].tier and r.step_id == inside[0].step_id
            at += r.length
        assert at <= inside[0].tier
        padded += at not in tiers
    # single-piece documents show their whole checksum; all lengths and starts add up
    for doc_id, own in pieces.items():
        assert sum(r.length for r in own) == sum(k[1] * n for k, n in want.items() if k[0] == doc_id)
        for r in own:
            if r.length == r.doc_tokens:
                assert (doc_id, r.doc_tokens, r.ids_crc32) in want
    return padded, windows


def test_packing_of_awkward_rows(spark):
    docs = awkward(spark).coalesce(1)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.packed_sequences(docs, tokenizer_path()).collect()
    padded, _ = check_packing(rows, texts, packing.TIERS)
    assert padded <= 1
    assert packing.packed_sequences(documents(spark, []), tokenizer_path()).count() == 0


def test_pieces_hold_every_id_once(spark):
    """Checksums of all pieces against the slices that their places name."""
    from tokenizers import Tokenizer

    docs = documents(spark, [prose(i, 3 + i * 7) for i in range(120)]).repartition(3)
    t = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    rows = packing.packed_sequences(docs, tokenizer_path(), step=4096).collect()
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id][r.start:r.start + r.length] += 1
    assert all((s == 1).all() for s in seen.values())
    padded, windows = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], packing.TIERS)
    assert padded <= 3
    steps = Counter()
    for inside in windows.values():
        steps[inside[0].step_id] += inside[0].tier
    assert sorted(steps) == list(range(len(steps)))
    assert all(n == 4096 for s, n in steps.items() if s < len(steps) - 1)


def test_packer_keeps_short_documents_whole_where_they_fit():
    packer = packing.Packer((4, 8, 16))
    for i, n in enumerate([13, 9, 7, 3, 3, 2, 40]):
        packer.add(i, np.arange(n, dtype="<u4"))
    packer.finish()
    lengths = [[p.key[0] for p in window] for _, window in packer.full]
    assert sorted(map(sum, lengths)) == sorted([16, 16, 16, 16, 8, 4, 1])
    assert [13, 3] in lengths and [9, 7] in lengths
    assert sum(map(sum, lengths)) == 77
