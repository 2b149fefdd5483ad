from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import fill_middle, queries

NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    """The contract, one text at a time."""
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    units = TOKEN.findall(text)
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("step", [40, 4 << 20])
def test_kernel_against_single_texts(monkeypatch, step):
    monkeypatch.setattr(fill_middle.steps, "__defaults__", (step,))
    r = random.Random(3)
    letters = [*"ab  \t\n\x0b\x0c\r<>PSM", "é", "漢", "😀", " ", " ", "\x00", "\x1c"]
    texts = [None, "", "<P>", "x<", "S>", "<", "P>"] + ["".join(r.choices(letters, k=r.randrange(60))) for _ in range(4_000)]
    digests = b"".join(hashlib.sha256(f"42:{i}".encode()).digest() for i in range(len(texts)))
    draws = np.frombuffer(digests, ">u4").reshape(-1, 8)[:, :4].T
    made = list(zip(*fill_middle.filled(pa.array(texts), draws, 50, 80), strict=True))
    assert [(*x[:4], x[4].decode()) for x in made] == [plainly(i, t) for i, t in enumerate(texts)]
    assert {x[1] for x in made} == {"plain", "spm", "psm"}
    outputs = pa.array([x[4].decode() for x in made])
    assert [x.decode() for x in fill_middle.restored(outputs, [x[1] for x in made])] == [t or "" for t in texts]
    part = list(zip(*fill_middle.filled(pa.array(texts)[100:200], draws[:, 100:200], 50, 80), strict=True))
    assert part == made[100:200]  # a slice of a larger buffer


def test_odd_rows_and_clashing_names(spark, odd_docs):
    more = odd_docs.withColumns({c: F.lit("x") for c in ("n", "form", "output", "digest", "prefix_chars")})
    found = fill_middle.transformed(more)
    assert found.columns == ["doc_id", *NAMES]
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert rows == sorted(((i, *plainly(i, t)) for i, t, *_ in odd_docs.collect()), key=repr)
    back = fill_middle.with_restored(found).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(x["restored_sha256"] for x in back) == sorted(digest(x["text"] or "") for x in odd_docs.collect())
    assert sorted(x["output_sha256"] for x in back) == sorted(digest(x[-1]) for x in rows)


def test_empty_table_and_query(spark, no_docs, odd_docs, stored):
    assert fill_middle.with_restored(fill_middle.transformed(no_docs)).collect() == []
    found = queries.op11_fill_middle(spark, stored(documents=odd_docs))
    assert found.columns == ["doc_id", *NAMES[:-1], "output_sha256", "restored_sha256"]
    assert found.count() == odd_docs.count()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
