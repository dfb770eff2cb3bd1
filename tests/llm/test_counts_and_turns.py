"""Token counts and repaired conversations against brute force and on odd rows."""

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers as P
import pytest
from odd_rows import TEXTS

from tessera.llm import catalog, conversations, token_counts
from tessera.llm.shared import read, stored

MODEL = P.path("piece_bpe_32k.model")


# 11 token counts


def test_token_counts_whole_query(spark, sf_dir):
    docs = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in catalog.QUERIES["op11_token_counts"](spark, sf_dir).collect()} == brute.token_count_rows(docs, MODEL, 4096)


def test_token_counts_on_odd_rows(spark, odd, none):
    want = Counter(r for row in TEXTS for r in brute.token_count_rows([row], MODEL, 100))
    assert Counter(tuple(r) for r in token_counts.count_tokens(odd, MODEL, 100).collect()) == want
    assert token_counts.count_tokens(none, MODEL, 100).count() == 0


def test_token_counts_of_spaces_and_marks(monkeypatch):
    counter = token_counts.TokenCounter(MODEL)
    monkeypatch.setattr(token_counts, "CHARS_AT_ONCE", 20)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    parts = [" ", "  ", "   ", "▁", "▁▁", "a", "the", "\n", "\t", "é", "😀", " ", "<s>", "</s>", "<unk>", "ing", "12", ".", "\x00", " " * 17, "▁ ▁", "word", "<0x0A>"]
    some = random.Random(1)
    texts = ["".join(some.choices(parts, k=some.randint(0, 12))) for _ in range(5000)] + ["", " ", "  ", "▁", "a ", " a", "x" * 5000]
    import pyarrow as pa

    assert counter.count(pa.array(texts, pa.large_string())).tolist() == [len(ids) for ids in counter.model.encode(texts)]


def test_single_tokens_are_proved():
    counter = token_counts.TokenCounter(MODEL)
    words = counter.single.to_pylist()
    assert len(words) > 10_000 and all(len(ids) == 1 for ids in counter.model.encode(words))


# 13 conversations


def test_conversations_whole_query(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in catalog.QUERIES["op13_conversations"](spark, sf_dir).collect()} == brute.conversation_rows(rows)


def _random_turns(some, many, longest):
    texts = ["Yes.", "No?", "Well", "", " \t", "One. Two", "Fine! ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    return [
        (conv if conv else None, some.choice([None, turn, turn, turn, turn + some.randint(0, 3)]), some.choice(roles), some.choice([f"Text {turn}.", *texts]))
        for conv in range(many)
        for turn in range(some.randint(1, longest))
    ]


@pytest.mark.parametrize("at_once", [1 << 18, 7])
def test_conversations_on_odd_rows(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(conversations, "TURNS_AT_ONCE", at_once)
    some = random.Random(at_once)
    rows = _random_turns(some, 300, 12) + [(1000, n % 250, ["user", "assistant", "system"][n % 7 % 3], f"Turn {n % 400}.") for n in range(2000)]
    rows += [(2000, 3, "user", "Twice.")] * 3 + [(3000, None, None, None)]
    path = str(tmp_path / "conversations.parquet")
    turns = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, conv string, audit string, digest string")
    turns.write.parquet(path)
    got = catalog.QUERIES["op13_conversations"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.conversation_rows(rows))
    assert {tuple(r) for r in catalog.QUERIES["op13_conversations"](spark, str(tmp_path)).collect()} == {tuple(r) for r in got}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There"), (1, 2, "tool", "ok."), (2, 0, "assistant", "Only!"), (3, 0, "user", " ")]
    turns = spark.createDataFrame(rows, "c long, turn long, role string, text string")
    audits = stored(conversations.audit_conversations(turns, "c"))
    got = {}
    for r in conversations.repaired_turns(turns, audits, "c").orderBy("c", "place").collect():
        got.setdefault(r.c, []).append((r.role, r.text))
    for conv in (1, 2, 3):
        assert got.get(conv, []) == list(brute.repair([r[1:] for r in rows if r[0] == conv])[1])
    assert {r.c: r.audit for r in audits.collect()}[3] == "D"


def test_conversations_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert catalog.QUERIES["op13_conversations"](spark, str(tmp_path)).collect() == []


def test_tensors_do_not_depend_on_their_cut(monkeypatch):
    some = np.random.default_rng(3)
    lengths = some.integers(1, 40, 200)
    codes = some.integers(0, 16, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    whole = conversations.solve(codes, starts, lengths)
    monkeypatch.setattr(conversations, "TENSOR_CELLS", 50)
    parts = conversations.solve(codes, starts, lengths)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]
