"""Byte-level BPE ids of whole Arrow batches: texts are split by numpy, and each distinct piece is encoded once a worker."""

import base64

import numpy as np

from tessera.llm.common import span_hashes, worker_cache

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_SLOTS, _POOL = 1 << 20, 1 << 22
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def _kinds() -> np.ndarray:
    """Of each code point: letter, number, white space or other, as the pattern of the vocabulary has them."""
    cache = worker_cache()
    if "kinds" not in cache:
        import regex

        kinds, every = np.full(0x110000, _OTHER, np.uint8), "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                kinds[a : b + 1] = kind
        cache["kinds"] = kinds
    return cache["kinds"]


def piece_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pieces of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` start in texts that start at firsts."""
    n = len(codes)
    kind = _kinds()[codes]
    begin = np.zeros(n + 1, bool)
    begin[firsts] = begin[n] = True
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= begin[:n]
    space = kind == _SPACE
    # a run of other characters takes a blank before it along; any other last white space of a run stands alone
    heads = np.flatnonzero(cut & ~space)
    after = heads[(heads > 0)]
    after = after[space[after - 1] & ~begin[after]]
    blank = codes[after - 1] == 32
    cut[after[blank]] = False
    cut[after - 1] = True
    # contractions
    for q in np.flatnonzero((codes == 39) & cut):
        if q and codes[q - 1] == 32 and not begin[q]:
            continue
        for end in _ENDINGS:
            e = q + 1 + len(end)
            if e <= n and not begin[q + 1 : e].any() and all(codes[q + 1 + t] == ord(c) for t, c in enumerate(end)):
                cut[q + 1 : e] = False
                if e < n:
                    cut[e] = True
                break
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts; keeps what it has encoded in tables of fixed size."""

    def __init__(self, name: str):
        """name: a vocabulary in the tokenizers' format; ranks of the same vocabulary lie beside it as .tiktoken."""
        import json

        import public_tokenizers
        import tiktoken

        self.name, self.tokenizer = name, None
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb"))}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.small = self.is_small(name)
        self.special = [t["content"] for t in json.load(open(public_tokenizers.path(name), encoding="utf-8"))["added_tokens"]]
        self.clear()

    @staticmethod
    def get(name: str) -> "Encoder":
        cache = worker_cache()
        if ("encoder", name) not in cache:
            cache["encoder", name] = Encoder(name)
        return cache["encoder", name]

    @staticmethod
    def is_small(name: str) -> bool:
        """Whether all ids fit in 16 bits."""
        import json

        import public_tokenizers

        made = json.load(open(public_tokenizers.path(name), encoding="utf-8"))
        return max([*made["model"]["vocab"].values(), *[t["id"] for t in made["added_tokens"]]]) < 65536

    def whole(self, text: str) -> list[int]:
        """Ids of a text with strings of special tokens, by the tokenizer itself."""
        if self.tokenizer is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(public_tokenizers.path(self.name))
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self):
        self.keys, self.at, self.size = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, ids: list[int]) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's start (one more than texts)."""
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:  # the strings of special tokens
            own = {k: np.array(self.whole(texts[k]), np.int32) for k in odd}
            ids, at = self.encode(["" if k in own else t for k, t in enumerate(texts)])
            parts = [own[k] if k in own else ids[at[k] : at[k + 1]] for k in range(len(texts))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        if self.used > _POOL:
            self.clear()
        text = "".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lens)])
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(codes, bounds[:-1][lens > 0])
        ends = np.append(starts[1:], len(codes))
        h = span_hashes(codes, starts, ends)
        slot = (h >> np.uint64(44)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where, long = np.empty(len(new), np.int32), np.empty(len(new), np.int32)
            encode = self.core.encode_single_piece
            for k, p in enumerate(miss[first].tolist()):
                ids = encode(text[starts[p] : ends[p]].encode())
                where[k], long[k] = self._add(ids), len(ids)
            at[miss], size[miss] = where[back], long[back]
            slot = (new >> np.uint64(44)).astype(np.int64)
            self.keys[slot], self.at[slot], self.size[slot] = new, where, long
        before = np.cumsum(size) - size
        out = self.pool[np.repeat(at - before, size) + np.arange(int(size.sum()))]
        total = np.append(before, len(out))
        return out, total[np.searchsorted(starts, bounds)]
