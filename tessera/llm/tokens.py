"""Token ids of texts by a public tokenizer file, with a memo of what stands between spaces."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import regex

from .hashing import MARK, run_hashes

#: The tokenizer of the contracts; its file is named by public_tokenizers.path().
TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Entries that a worker's memo holds before it starts afresh, and characters of texts encoded at once.
MEMO, CHUNK = 1_000_000, 1 << 20
#: Ids that the memo holds for each of its entries, on average.
MEMO_IDS = 8
#: Words that the model gets at once, and bytes of a piece whose ids are kept.
GROUP, SHORT = 64, 32
#: Punctuation marks at most at the end of a word that is encoded with others.
TAIL = 4
#: Bytes that letters may have; visible ASCII.
LETTER = np.array([k > 127 or chr(k).isalpha() for k in range(256)])
VISIBLE = (np.arange(256) > 32) & (np.arange(256) < 127)


def byte_letters() -> str:
    """The letters by which a byte-level vocabulary writes the bytes from 0 to 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


LETTERS = byte_letters()
SPACE, LINE = LETTERS[32], LETTERS[10]


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs of these starts and sizes, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of whole texts as arrays of unsigned 32-bit numbers.

    A byte-level pattern never joins what stands before a single space to what
    follows it, nor what stands on either side of a line feed between visible
    characters. So a text is the ids of its words, each with the space or line
    feed before it. The distinct words of a batch of texts (told apart by 64-bit
    hashes of their bytes) are looked up or encoded once, and the ids of all
    texts are gathered from them. The tokenizer's model does the work; it gets
    the letters of many words at once where no token of its vocabulary can reach
    from one to the next. Texts with runs of spaces or with a special token go
    to the tokenizer whole.
    """

    def __init__(self, file: str, memo: int = MEMO):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.memo = memo
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[k for token, k in vocab.items() if token.startswith((SPACE, LINE))]] = True
        self.apart = self.keeps_apart(vocab)
        self.clear()

    def keeps_apart(self, vocab: dict[str, int]) -> bool:
        """Whether words of letters, each with a space or line feed before it, have the ids one after another that their pieces have."""
        whole = ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
        if not vocab.keys() >= set(LETTERS) or any(getattr(self.model, k, None) for k in whole):
            return False
        for token in vocab:
            head, *parts = token.replace(LINE, SPACE).split(SPACE)
            if len(parts) > 1 or parts and (head or token[0] == LINE and parts[0]):
                # it reaches over a word's end or a line feed, unless letters cannot stand as it has them
                parts = [bytes(map(LETTERS.index, p)).decode(errors="ignore") for p in parts]
                if all(p.isalpha() for p in parts[:-1]) and (not parts[-1] or parts[-1].isalpha()):
                    return False
        return True

    def clear(self) -> None:
        self.known: dict[bytes, list[int]] = {}
        # hashes of words in ascending order, and each one's slot in at and size
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def piece(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(codecs.charmap_decode(piece, "strict", LETTERS)[0])]

    def kept(self, piece: bytes) -> list[int]:
        """Ids of a piece; those of short ones are kept."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.piece(piece)
            if len(piece) <= SHORT:
                if len(self.known) >= self.memo:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def cores(self, cores: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each with a space or line feed before it, one after another, and how many each has."""
        groups = (cores[k : k + GROUP] for k in range(0, len(cores), GROUP))
        ids = np.array([k for g in groups for k in self.piece(b"".join(g))], "<u4")
        return ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))

    def words(self, raw: bytes, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[start:end], each with a space or line feed before it, one after another, and how many each has. b: raw as an array."""
        stop = end.copy()
        for _ in range(TAIL):
            stop -= MARK[b[stop - 1]]
        other, wide = np.cumsum(~LETTER[b], dtype=np.int32), np.cumsum(b > 127, dtype=np.int32)
        plain = (stop - start > 1) & (other[stop - 1] == other[start]) & self.apart
        for k in np.flatnonzero(plain & (wide[stop - 1] > wide[start])).tolist():
            plain[k] = raw[start[k] + 1 : stop[k]].decode().isalpha()
        ids, n_core = self.cores([raw[i:j] for i, j in zip(start[plain].tolist(), stop[plain].tolist(), strict=True)])
        rests: list[list[int]] = [[]] * len(start)
        tail, odd = np.flatnonzero(plain & (stop < end)), np.flatnonzero(~plain)
        for k, i, j in zip(tail.tolist(), stop[tail].tolist(), end[tail].tolist(), strict=True):
            rests[k] = self.kept(raw[i:j])
        for k, i, j in zip(odd.tolist(), start[odd].tolist(), end[odd].tolist(), strict=True):
            rests[k] = [n for p in self.pieces.findall(raw[i:j].decode()) for n in self.kept(p.encode())]
        n_first, n_rest = np.zeros(len(start), np.int64), np.array([len(r) for r in rests], np.int64)
        n_first[plain] = n_core
        size = n_first + n_rest
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), "<u4")
        out[places(at, n_first)] = ids
        out[places(at + n_first, n_rest)] = [n for r in rests for n in r]
        return out, size

    def add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slots of new words with these ids one after another, so many each."""
        n, m = len(self.keys), len(self.keys) + len(size)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        while m > len(self.at):
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[n:m], self.size[n:m] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        return np.arange(n, m)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def by_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without runs of spaces or special tokens; a space stands before each."""
        texts = [t.encode() for t in texts]
        raw = b" " + b" ".join(texts)
        b = np.frombuffer(raw, np.uint8)
        line = np.flatnonzero(b[:-1] == 10)
        line = line[VISIBLE[b[line - 1]] & VISIBLE[b[line + 1]]]
        mark = b == 32
        mark[line] = True
        start = np.flatnonzero(mark)
        end = np.append(start[1:], len(b))
        hashes = run_hashes(b, start, end)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.memo or self.used > MEMO_IDS * self.memo:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        old = np.zeros(len(distinct), bool)
        inside = np.flatnonzero(place < len(self.keys))
        old[inside] = self.keys[place[inside]] == distinct[inside]
        slot = np.empty(len(distinct), np.int64)
        slot[old] = self.slots[place[old]]
        new = np.flatnonzero(~old)
        if len(new):
            word = first[new]
            slot[new] = self.add(*self.words(raw, b, start[word], end[word]))
            self.keys, self.slots = np.insert(self.keys, place[new], distinct[new]), np.insert(self.slots, place[new], slot[new])
        slot = slot[back]
        size, at = self.size[slot], self.at[slot]
        ends = np.cumsum(size)
        ids = self.flat[places(at, size)]
        of_text = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        return np.split(ids, ends[of_text[:-1] - 1])

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text and, after them, the end id; a null or empty text has the end id only. About CHUNK characters at a time."""
        done, held = 0, 0
        for k, t in enumerate(texts):
            held += len(t or "")
            if held >= CHUNK or k == len(texts) - 1:
                yield from self._encode_all(texts[done : k + 1])
                done, held = k + 1, 0

    def _encode_all(self, texts):
        end = np.array([END], "<u4")
        plain = [bool(t) and "  " not in t and not any(s in t for s in self.special) for t in texts]
        # a text's first word has no space before it
        heads = [t.partition(" ") for t, p in zip(texts, plain, strict=True) if p]
        tails = [tail for _, space, tail in heads if space]
        rest = iter(self.by_words(tails) if tails else [])
        heads = iter(heads)
        for t, p in zip(texts, plain, strict=True):
            if p:
                head, space, _ = next(heads)
                yield np.concatenate([*([self.whole(head)] if head else []), *([next(rest)] if space else []), end])
            else:
                yield np.concatenate([self.whole(t), end]) if t else end

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text])).tobytes()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(file: str | None = None, memo: int = MEMO) -> Encoder:
    """This worker's encoder for a tokenizer file, with a memo of so many entries at most; without a file, that of TOKENIZER."""
    import public_tokenizers

    key = file or public_tokenizers.path(TOKENIZER), memo
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
