"""Operators on texts against brute force, on an awkward table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import blocks, bpe, exact_dedup, near_dedup, packing, substring, token_files, tokens
from sparkloom.llm.common import scratch
from sparkloom.llm.elias_fano import EliasFano
from tests.llm.fixtures import documents, empty, frame

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def multiset(rows):
    return sorted(map(tuple, rows), key=repr)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.mark.parametrize("path", [BYTES, WORDS])
@given(text=st.text(st.sampled_from("aZé ß\n\t　\x85.,'s1<|>endoftxÀ́İΣ ")) | st.text())
@settings(max_examples=150, deadline=None)
def test_chunks_give_the_librarys_ids(path, text):
    text = text.encode("utf-8", "ignore").decode()
    own = tokens.encoder(path)
    ids = np.frombuffer(own.encode([text, "filler " + text])[0], own.dtype).tolist()
    assert ids == own.tokenizer.encode(text, add_special_tokens=False).ids
    texts = ["", text, "plain words, 12 of them\n\n  here ", text + " Ünd so", None]
    found, edges = own.encode_array(pa.array([x or "" for x in texts]).slice(1), end=7, most=20)
    want = [[*own.tokenizer.encode(x or "", add_special_tokens=False).ids, 7] for x in texts[1:]]
    assert [found[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(bpe, "PART_BYTES", 1000)
    t = Tokenizer.from_file(BYTES)
    want = []
    for d, x in documents():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    assert multiset(bpe._coded(frame(spark), BYTES, schema, bpe._digests).collect()) == multiset(want)
    assert bpe.encode_decode(empty(spark), BYTES).collect() == []
    back = bpe.encode_decode(frame(spark, [(1, "ab cd"), (2, None)]), BYTES).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {1: b"ab cd", 2: b""}


def test_blocks_follow_the_files(spark, monkeypatch):
    """Rows without doc_id spread over blocks like any others, and blocks are the same when they are made again."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1000)
    df = frame(spark, [(None, f"some words of text number {i}") for i in range(400)])
    packs = blocks.pack_blocks(df)
    got = packs.collect()
    assert len(got) >= 8 and sorted(map(tuple, got)) == sorted(map(tuple, packs.collect()))
    sizes = [blocks.unpack([pa.scalar(bytes(r.pack), pa.binary())]).num_rows for r in got]
    assert sum(sizes) == 400 and max(sizes) <= 40


def test_messages_of_a_block_are_bounded():
    words = pa.array([f"w{i}" for i in range(5000)])
    order, begin = bpe._dealt(words, 64)
    assert sorted(order) == list(range(5000)) and len(begin) == 65 and np.diff(begin).max() < 150
    assert bpe._dealt(words, 64)[0].tolist() == order.tolist()


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    assert len({(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}) == substring.PERIOD
    rows = documents()
    first = defaultdict(lambda: float("inf"))
    split = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for _, x in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(first[tuple(w[i : i + 50])], float("inf") if d is None else d)
    want = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (float("inf") if d is None else d):
                gone[i : i + 50] = [True] * 50
        want.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    assert sum(x[2] for x in want) > 0
    assert multiset(substring.dedup_substrings(frame(spark)).collect()) == multiset(want)
    assert substring.dedup_substrings(empty(spark)).collect() == []
    kept = substring.dedup_substrings(frame(spark), text=True, carry=("block", "uid")).collect()
    assert {(r.block, r.uid) for r in kept} == {("x", 1)} and len(kept) == len(rows)


def test_exact(spark):
    rows = documents()
    groups = defaultdict(list)
    for d, x in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", x or "")].append(d)
    got = exact_dedup.dedup_exact(frame(spark)).collect()
    assert len(got) == len(rows)
    for text, ids in groups.items():
        own = [r for r in got if r.text_sha256 == sha(text)]
        keep = min((d for d in ids if d is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [keep]
    assert exact_dedup.dedup_exact(empty(spark)).collect() == []


def test_the_index_goes_on(spark):
    path = scratch(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert {r.doc_id: r.kept for r in index.add(frame(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()} == {1: True, 2: True, 3: False}
    spark.sql(f"DROP TABLE {index.name}")  # the files stay, as for another session
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert {r.doc_id: (r.keep_id, r.kept) for r in again.add(frame(spark, [(4, "b"), (5, "c")])).collect()} == {4: (2, False), 5: (5, True)}
    assert {r.doc_id: r.kept for r in again.add(frame(spark, [(4, "b"), (5, "c")])).collect()} == {4: False, 5: True}  # added twice
    assert again.table().count() == 3
    assert "Exchange" not in again.table().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()


def test_indexes_of_like_names_are_apart(spark):
    first, second = (exact_dedup.DigestIndex(spark, f"{scratch(spark, 'place')}/index", 4) for _ in range(2))
    assert [r.kept for r in first.add(frame(spark, [(1, "x")])).collect()] == [True]
    assert [(r.keep_id, r.kept) for r in second.add(frame(spark, [(2, "x")])).collect()] == [(2, True)]
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, first.path, 8)
    first.add(frame(spark, [(3, "y"), (4, "x")])).collect()
    copy = first.compact(scratch(spark, "compact"))
    assert {r.keep_id for r in copy.table().collect()} == {1, 3} and len(copy.table().inputFiles()) <= 4
    first.drop()
    assert [r.kept for r in copy.add(frame(spark, [(5, "y"), (6, "z")])).collect()] == [False, True]


def test_a_compacted_index_knows_its_texts(spark):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "index"), 4)
    index.add(frame(spark, [(1, "x")])).collect()
    index.add(frame(spark, [(3, "y"), (4, "x")])).collect()
    copy = index.compact(scratch(spark, "compact"))
    index.drop()
    got = {r.doc_id: (r.keep_id, r.kept) for r in copy.add(frame(spark, [(5, "y"), (6, "z")])).collect()}  # rows come in any order
    assert got == {5: (3, False), 6: (6, True)}


@given(st.lists(st.integers(0, 5000), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    numbers = np.cumsum(np.array(steps, np.uint64))
    code = EliasFano.from_bytes(EliasFano.of(numbers).to_bytes())
    assert code.select(np.arange(len(numbers))).tolist() == numbers.tolist()
    assert [code.select(i) for i in range(len(numbers))] == numbers.tolist()
    picked = np.arange(len(numbers))[::3]
    assert code.select(picked).tolist() == numbers[picked].tolist()


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 4000)
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    t, path = Tokenizer.from_file(WORDS), scratch(spark, "tokens")
    token_files.write_tokens(frame(spark), path, WORDS, end_id=2)
    got = token_files.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in documents() if d is not None)) + [None, None]
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    want = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in documents()]
    assert multiset((r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in got) == multiset(want)
    none = scratch(spark, "tokens")
    token_files.write_tokens(empty(spark), none, WORDS, end_id=2)
    assert token_files.read_documents(spark, none).collect() == []
    seg = token_files.Segment.of(pa.array([5, None], pa.int64()), np.array([2, 0]), np.array([1, 2], "<u2"))
    back = token_files.Segment.from_bytes(seg.to_bytes())
    assert back.doc_ids.to_pylist() == [5, None] and back.offsets().tolist() == [0, 2, 2] and back.document(0).tolist() == [1, 2] and back.document(1).tolist() == []


def test_packing(spark):
    t = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(frame(spark), WORDS, end_id=1, capacity=256).collect()
    want = []
    for d, x in documents():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(d, k, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    assert multiset(tuple(r)[:5] for r in got) == multiset(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 256 + 1
    assert packing.pack_documents(empty(spark), WORDS, 1).collect() == []


def packed(lengths, placements, capacity):
    """Bins of lengths (longest first) as the placements say, each filled without gaps; the number of bins."""
    bins, at = defaultdict(list), 0
    for size, rank, pieces, first, offset in sorted(placements, key=lambda x: x[1]):
        assert rank == at and all(x == size for x in lengths[rank : rank + pieces])
        for i in range(pieces):
            bins[first + i].append((offset, size))
        at += pieces
    assert at == len(lengths)
    for pieces in bins.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= capacity
    return len(bins)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
@settings(max_examples=100, deadline=None)
def test_rounds_of_best_fit(lengths):
    lengths.sort(reverse=True)
    pieces = [(n, lengths.index(n), lengths.count(n)) for n in sorted(set(lengths))]
    gaps, bins, placed = [], 0, []
    while pieces:
        for width in (8, 32, 64):
            own, after = pieces, []
            pieces = []
            for low in range(1, 65, width):
                here = lambda x, low=low, width=width: low <= x[0] < low + width
                out, left, room = packing.sweep_range([x for x in own if here(x)], [x for x in gaps if here(x)], low, low + width - 1, 64)
                placed, pieces, after = placed + out, pieces + left, after + room
            gaps = after
        more, pieces, opened, bins = packing.open_bins(pieces, gaps, bins, 64)
        gaps, placed = gaps + opened, placed + more
    assert packed(lengths, [x[1:] for x in placed], 64) == bins <= sum(lengths) * 2 / 64 + 1


def test_a_sweep_takes_the_smallest_room_that_holds_a_piece():
    placed, filled, left, gaps = packing.sweep([(5, 0, 2), (3, 2, 2), (9, 4, 1)], [(6, 10, 1), (8, 20, 2), (3, 30, 1)], 10)
    assert sorted(placed) == sorted([(packing.PLACED, 5, 0, 1, 10, 4), (packing.PLACED, 5, 1, 1, 20, 2), (packing.PLACED, 3, 2, 1, 30, 7), (packing.PLACED, 3, 3, 1, 21, 2)])
    assert sorted(filled) == [(1, 10, 1), (3, 20, 1), (5, 21, 1)] and left == [(9, 4, 1)] and gaps == []


def test_best_fit_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "WIDTH", 4)
    monkeypatch.setattr(packing, "PARTITION_PIECES", 50)
    lengths = np.random.default_rng(1).geometric(0.08, 600).clip(1, 64)
    df = spark.createDataFrame([(int(n), i) for i, n in enumerate(lengths)], "length long, note long")
    got = packing.pack(df, 64).collect()
    assert sorted((r.length, r.note) for r in got) == sorted((int(n), i) for i, n in enumerate(lengths))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 64
    assert len(bins) <= 1.02 * lengths.sum() / 64 + 1


@pytest.mark.parametrize(("bucket", "chunk"), [(32, 2048), (2, 4)])
def test_near(spark, monkeypatch, bucket, chunk):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = documents()
    line = [f"n{i}" for i in range(12)]  # few runs, often: the similarity of plain sets would be another
    rows += [(700 + i, " ".join(line * n)) for i, n in enumerate((10, 11, 14, 30))]
    sets = []
    for _, x in rows:
        w = (x or "").split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        classes[root(i)].append(d)
    want = []
    for ids in classes.values():
        low = min((d for d in ids if d is not None), default=None)
        want += [(d, low, len(ids)) for d in ids]
    got = near_dedup.near_classes(frame(spark, rows)).collect()
    assert multiset(tuple(r)[:3] for r in got) == multiset(want)
    assert sum(r.kept for r in got) == len(classes)
    assert near_dedup.near_classes(empty(spark)).collect() == []


def join_rows(plan):
    """The rows that each join of an executed plan made."""
    name = plan.nodeName()
    inner = "plan" if name.endswith("QueryStage") else "executedPlan" if name == "AdaptiveSparkPlan" else None
    found = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    for child in [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]:
        found += join_rows(child)
    return found


def test_near_meets_a_node_once_for_all_its_larger_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 2)
    made, across = [], near_dedup._across

    def seen(large, *rest):
        out = across(large, *rest)
        out.collect()
        made.append((large.count(), large.select("node").distinct().count(), join_rows(out._jdf.queryExecution().executedPlan())))
        return out

    monkeypatch.setattr(near_dedup, "_across", seen)
    base = [f"w{i}" for i in range(200)]  # each text changes words of its own: about 0.73 like any other
    rows = [(n, " ".join(f"x{n}" if i % 67 == 3 * n % 67 else w for i, w in enumerate(base))) for n in range(16)]
    got = near_dedup.near_classes(frame(spark, rows)).collect()
    assert len(got) == 16 and len(made) == 1
    in_buckets, nodes, joins = made[0]
    assert in_buckets > 2 * nodes and len(joins) >= 3 and max(joins) <= nodes, (in_buckets, nodes, joins)
