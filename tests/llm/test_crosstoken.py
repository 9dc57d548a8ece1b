"""Alignment of two tokenizers against plain loops over the libraries' own ids."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioloom.llm import crosstoken as ct

SCHEMA = "doc_id long, text string, a string, b string, row long, key string, n long, groups string"


def byte_of():
    """The byte that each letter of the byte-level alphabet stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(texts, both):
    a, b = both
    letters, docs, pairs = byte_of(), [], Counter()
    for text in texts:
        tokens = [], []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            tokens = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids], []
            for i in b.encode(text):
                p = b.id_to_piece(i)
                tokens[1].append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
            if any(b"".join(x for _, x in t) != (" " + text).encode() for t in tokens):
                tokens = [], []
        spans = []
        for t in tokens:
            at, own = 0, []
            for i, x in t:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, t in own if s >= low and t <= e) for own in spans))
            low = e
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        pairs.update(links)
        docs.append((len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups)))
    best = {}
    for (_, j), n in pairs.items():
        best[j] = max(best.get(j, 0), n)
    return [(na, nb, g, len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), text) for na, nb, g, links, text in docs]


def corpus():
    r = random.Random(5)
    words = ["the", "Alignment", "naïve", "日本", "x" * 30, "don't", "12345", "3.14", "😀", "été", "á", "<|endoftext|>", "<s>", "<0x41>", "İ", "\t", "  ", "\n", "\r\n", "\x00", "\x0b", " ", "{[()]}", "thth", "ing"]
    rows = [None, "", " ", "  ", "x", "the ▁ sign", "▁", "<unk>", "　wide", "end \n", "the the the", "the the the"]
    rows += ["".join(r.choice(words) + r.choice(["", " ", " ", "  "]) for _ in range(r.choice([2, 10, 60]))) for _ in range(80)]
    rows.append("ab " * 3000 + "z" * 2000 + " " * 500)
    return rows


@pytest.mark.parametrize("lookup", ["shards", "join"])
def test_against_loops(spark, both, lookup, monkeypatch):
    rows = corpus()
    ids = [None, 7, 7, *range(3, len(rows))]
    docs = spark.createDataFrame([(i, t, "c", "c", 1, "c", 1, "c") for i, t in zip(ids, rows, strict=True)], SCHEMA).repartition(4)
    got = ct.align(spark, docs, lookup=lookup)
    want = Counter((i, *x) for i, x in zip(ids, plain(rows, both), strict=True))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {x[4] for x in want if x[1]} - {0}  # some links are their id's best


@pytest.mark.parametrize("lookup", ["shards", "join"])
def test_empty_tables(spark, lookup):
    docs = spark.createDataFrame([], SCHEMA)
    assert ct.align(spark, docs, lookup=lookup).collect() == []
    none = spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ct.align(spark, none, lookup=lookup).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_small_pieces_at_a_time(both, monkeypatch):
    """Partial counts that are given out early, and documents aligned a few at a time, add up to the same."""
    import pyarrow as pa

    rows = [t for t in corpus() if t and "▁" not in t][:60]
    table = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows)], names=["doc_id", "text"])
    monkeypatch.setattr(ct, "released", lambda x: x)

    class Context:
        partitionId = staticmethod(lambda: 2)

    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Context))
    [ids] = ct._encoded(ct.VOCABULARY_A, ct.VOCABULARY_B)([table])
    assert ids.column(0).to_pylist() == [(2 << 40) + i for i in range(len(rows))]

    def counted():
        out = Counter()
        for b in ct._partial(ct.VOCABULARY_A, ct.VOCABULARY_B)([ids, ids]):
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[k] += n
        return out

    whole = counted()
    monkeypatch.setattr(ct, "_TOKENS", 50)
    monkeypatch.setattr(ct, "_HELD", 20)
    assert counted() == whole and len(whole) > 100


def test_runs_cross_batches(tmp_path):
    """A key's run may begin in one batch and end in another."""
    import pyarrow as pa

    rows = [(k << 32 | a, n) for k, a, n in ((0, 5, 1), (0, 5, 2), (1, 5, 3), (1, 5, 4), (1, 5, 5), (1, 6, 12), (3, 9, 1))]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in x], pa.int64()), pa.array([n for _, n in x], pa.int64())], names=["key", "n"]) for x in (rows[:1], rows[1:3], [], rows[3:4], rows[4:])]
    [out] = ct._shards(str(tmp_path / "s"), 8)(batches)
    path, keys, first = (out.column(i)[0].as_py() for i in range(3))
    assert (keys, first) == (4, 5)
    index = ct.Index([(first, path, keys)], None)
    assert index.counts(np.array([5, 1 << 32 | 5, 1 << 32 | 6, 3 << 32 | 9])).tolist() == [3, 12, 12, 1]
    assert list(zip(out.column(3).to_pylist()[1:], out.column(4).to_pylist()[1:], strict=True)) == [(0, 3), (1, 12), (3, 1)]
    assert list(ct._shards(str(tmp_path / "t"), 8)(iter([]))) == []
