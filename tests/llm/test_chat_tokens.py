import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import chat_snapshots, queries, token_counts

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _chats():
    r = random.Random(4)
    full = {i: [(("user", "assistant")[t % 2], f"t{r.randint(0, 3)}") for t in range(r.randint(1, 7))] for i in range(60)}
    for i in range(60, 120):  # snapshots
        base = full[r.randrange(60)]
        full[i] = base[: r.randint(1, len(base))]
    full[200] = [("user", None), (None, "x")]
    full[201] = [("user", "")]
    full[202] = [("user", None)]
    return full


def _brute(full):
    return {i for i, c in full.items() if not any(len(d) > len(c) and d[: len(c)] == c for d in full.values())}


@pytest.mark.parametrize("chunk", [1024, 2])
def test_maximal_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat_snapshots, "CHUNK", chunk)
    full = _chats()
    rows = [(i, t, role, text) for i, c in full.items() for t, (role, text) in enumerate(c)]
    random.Random(1).shuffle(rows)
    out = chat_snapshots.rendered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.conv_id for r in out} == _brute(full)
    for i in _brute(full):
        parts = sorted((r.part, r.chat) for r in out if r.conv_id == i)
        want = "".join(f"<|{role or ''}|>\n{text or ''}\n" for role, text in full[i])
        assert "".join(c for _, c in parts) == want


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, None, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "user", "a")]
    out = {r.conv_id: r for r in chat_snapshots.rendered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {None, 1}  # conversation 2 is a prefix of 1
    assert out[None].n_turns == 2 and out[None].chat.index("b") < out[None].chat.index("a")
    assert chat_snapshots.rendered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_round_trip():
    for text in ("plain words here", "ß é 漢字 🙂🙂 x", "", "a" * 3000, "\n\n x"):
        starts, ends = token_counts.token_spans(text, queries.VOCABULARY)
        assert (ends[:-1] == starts[1:]).all() and (not text or (starts[0] == 0 and ends[-1] == len(text)))


def _brute_allot(starts, ends, bounds, rule):
    out = np.zeros(len(bounds))
    for s, e in zip(starts, ends, strict=True):
        chars = [next(k for k, b in enumerate(bounds) if c < b) for c in range(s, e)]
        if rule == "first":
            out[chars[0]] += 1
        elif rule == "most":
            out[max(sorted(set(chars)), key=chars.count)] += 1
        else:
            for c in chars:
                out[c] += 1 / (e - s)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allotment_matches_brute_force(rule):
    r = random.Random(3)
    for _ in range(100):
        n = r.randint(1, 30)
        cuts = sorted(r.sample(range(1, n), min(n - 1, r.randint(0, 8))))
        starts, ends = np.array([0, *cuts]), np.array([*cuts, n])
        bounds = np.array(sorted({*r.sample(range(1, n + 1), min(n, r.randint(0, 6))), n}))
        got, _ = token_counts.allotted(starts, ends, bounds, rule)
        assert got == pytest.approx(_brute_allot(starts, ends, bounds, rule))


def test_sections_add_up(spark, odd_docs, no_docs, stored):
    out = queries.op6_token_counts(spark, stored(documents=odd_docs)).collect()
    import tiktoken  # noqa: F401

    total = {r.doc_id: 0 for r in out}
    for r in out:
        total[r.doc_id] += r.n_tokens
    nine = next(r.text for r in odd_docs.where("doc_id = 9").collect())
    assert total[9] == len(token_counts.token_spans(nine, queries.VOCABULARY)[0])
    assert [(r.section, r.char_start, r.char_end) for r in out if r.doc_id == 9] == [(0, 0, 13), (1, 13, 25)]
    assert 3 not in total and 4 not in total and 5 in total
    assert token_counts.section_tokens(no_docs, queries.VOCABULARY).count() == 0
    ends = spark.createDataFrame([(1, "abc def ghi", [3, None, 99, 7]), (2, "xyz", None)], "doc_id bigint, text string, ends array<bigint>")
    got = token_counts.section_tokens(ends, queries.VOCABULARY, "shared", sections="ends").collect()
    assert [(r.doc_id, r.char_end) for r in got] == [(1, 3), (1, 7), (1, 11), (2, 3)]


def test_clashing_names(spark, odd_docs):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "c")]
    turns = spark.createDataFrame(rows, SCHEMA)
    more = turns.withColumns({c: F.lit("x") for c in ("pos", "n", "part", "prefix", "chat", "n_turns", "h", "hash")})
    assert sorted(map(repr, chat_snapshots.rendered(more).collect())) == sorted(map(repr, chat_snapshots.rendered(turns).collect()))
    wide = odd_docs.withColumnsRenamed({"source": "section", "lang": "n_tokens"}).withColumns({c: F.lit(1) for c in ("char_start", "char_end", "n_crossing", "_text")})
    plain = token_counts.section_tokens(odd_docs, queries.VOCABULARY)
    assert sorted(map(repr, token_counts.section_tokens(wide, queries.VOCABULARY).collect())) == sorted(map(repr, plain.collect()))
