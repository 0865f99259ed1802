import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, token_files, tokens
from tessera.llm.tokens import TOKENIZER, encoder

TEXTS = ["", None, "Hello world", "a  b   c", " x", "x ", "tab\there \nnew\n\n line", "don't we'll", "<|endoftext|> é ß 漢字 🙂", "...", "1,234.5 abc, def.", "a b", "word " * 5000, "<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>b c"]
ROWS = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(3, "a  b   c", "clash"), (None, "no id", "clash")]


def ids(text):
    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("text", TEXTS)
def test_memo_equals_the_tokenizer(text):
    assert encoder().encode(text) == ids(text).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \n\tab'sé.,1漢Z ", max_size=30))
def test_memo_equals_the_tokenizer_for_any_text(text):
    assert encoder().encode(text) == ids(text).tobytes()


@pytest.mark.parametrize("chunk", [1, 20, 1 << 21])
def test_batches_equal_the_tokenizer(chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    texts = TEXTS + ["Ab, ab. Ab", " ab", "ab\ncd ef"] + TEXTS
    assert [x.tolist() for x in encoder(memo=3).encode_all(texts)] == [ids(t).tolist() for t in texts]
    assert list(encoder().encode_all([])) == []


class Counted:
    """A model that counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, letters):
        self.calls += 1
        return self.model.tokenize(letters)


def test_new_words_go_to_the_model_together():
    own = tokens.Encoder(public_tokenizers.path(TOKENIZER))
    own.model = Counted(own.model)
    r = random.Random(4)
    texts = [" ".join("".join(r.choices("abcdefgé", k=9)) + r.choice(["", ",", ".\nBut"]) for _ in range(1000))]
    assert [x.tolist() for x in own.encode_all(texts)] == [ids(texts[0]).tolist()]
    assert own.model.calls < 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="\n\t\x1c\xa0 '\"sab,.!é漢Ⅷ×—🙂1", max_size=30), max_size=20))
def test_odd_words_of_a_batch_equal_the_tokenizer(texts):
    own = encoder(memo=50)
    for apart in (True, False):
        own.clear()
        own.apart = apart
        assert [x.tolist() for x in own.encode_all(texts)] == [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_words_go_together_only_where_no_token_reaches_over_their_ends():
    own = tokens.Encoder(public_tokenizers.path(TOKENIZER))
    space, line = tokens.SPACE, tokens.LINE
    letters = dict.fromkeys(tokens.LETTERS, 0)
    assert own.apart and own.keeps_apart(letters)
    for token in (f"a{space}", f"{space}a{space}b", f"{line}a", f"a{line}", f"{space}a{line}", f"{line}Ã"):
        assert not own.keeps_apart(letters | {token: 1})
    for token in (f"{space}ab", f"{space}{space}", f"{line}{line}", f"{line}Âł", f"{space}Âł{space}Âł", f"{space}.{line}"):
        assert own.keeps_apart(letters | {token: 1})


def test_the_memo_is_bounded_by_its_ids_too():
    own = tokens.Encoder(public_tokenizers.path(TOKENIZER), memo=100)
    for k in range(30):
        own.encode(f"x {k}" + "-=" * 500)
    assert own.used <= 100 * tokens.MEMO_IDS + 2000 and len(own.keys) < 30


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32 - 1])
def test_blocks_come_back(high):
    r = np.random.default_rng(high)
    v = np.where(r.random(128 * 20) < 0.95, r.integers(0, min(high, 9), 128 * 20), r.integers(0, high, 128 * 20)).astype(np.uint32)
    raw, size = token_files.encode_blocks(v)
    assert (token_files.decode_blocks(raw, np.cumsum(size) - size) == v).all()


def test_files_come_back(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    manifest = token_files.write(docs, f"file://{tmp_path}/ids")
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    at = 0
    for g, w in zip(got, want, strict=True):
        v = ids(w[1])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(v), zlib.crc32(v.tobytes()))
        at += len(v)
    assert token_files.read(token_files.write(docs.limit(0), f"file://{tmp_path}/none")).count() == 0


def holds(rows, docs, size):
    """Every document's pieces are whole and every sequence is gapless."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want = defaultdict(list)
    for doc_id, text, *_ in docs:
        v = ids(text)
        start, end = 0, (len(v) - 1) % size + 1
        for piece in range(-(-len(v) // size)):
            want[doc_id].append((piece, start, end - start, zlib.crc32(v[start:end].tobytes())))
            start, end = end, end + size
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_seq)


def test_sequences(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, offset string")
    rows = packing.sequences(docs).collect()
    total = sum(len(ids(r[1])) for r in ROWS)
    assert holds(rows, ROWS, packing.SIZE) == -(-total // packing.SIZE)
    assert packing.sequences(docs.limit(0)).count() == 0


def fewest(lengths, size):
    """Fewest bins by trying everything."""
    best = [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            go(k + 1, [r - lengths[k] * (j == i) for j, r in enumerate(rooms)])
        go(k + 1, [*rooms, size - lengths[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_against_all_packings(seed):
    r = random.Random(seed)
    lengths = sorted((r.randint(1, 20) for _ in range(r.randint(1, 10))), reverse=True)
    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.pack(counts, 20)
    used = defaultdict(int)
    for bins, has in plan:
        assert sum(n * m for n, m in has) <= 20
        for n, m in has:
            used[n] += bins * m
    assert used == counts
    bins = sum(b for b, _ in plan)
    assert packing.lower_bound(counts, 20) <= fewest(lengths, 20) == bins


def test_tasks_of_token_files_hand_memory_back(spark, tmp_path, monkeypatch):
    given = []
    monkeypatch.setattr(token_files, "giving_back", lambda part: given.append(part) or part)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    assert token_files.read(token_files.write(docs, f"file://{tmp_path}/ids")).count() == len(ROWS)
    assert len(given) == 2
