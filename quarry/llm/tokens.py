"""Token ids of a public byte-level BPE vocabulary, the same as the ``tokenizers`` library gives."""

from __future__ import annotations

import json
import os

import numpy as np

#: Texts that both libraries must encode alike before the faster one is used: the same for every worker, whatever its rows.
PROBES = [
    "", " ", "  a  b ", "It's we'll they've I'd you're I'm don't 'S 'LL", "\r\n\t\x0b\x0c\x85\xa0 x\u3000y\u2003 z\u200b", "a1b22c 333 4444 ½ Ⅷ ² ٣",
    "...!?  --- ___ <|x|> ### $$", "naïve café e\u0301 ñ Straße İstanbul ﬁ", "日本語のテキスト 中文 한국어", "\U0001f600\U0001f468\u200d\U0001f469 👍🏽", "\x00\x01\x7f\ufffd\ufeff", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "    def f(x):\n        return x\n\n\n",
]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary is; the path is a parameter of every operator that needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def size_of(path: str) -> int:
    """One more than the largest id of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max(*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", [])))


class Tokens:
    """Encodes texts; ``special``: strings of special tokens in a text become their ids, as by default in ``tokenizers``.

    Where the vocabulary's ids follow its merges and its pattern is the byte-level one, the ids are fixed by the vocabulary
    alone, and ``tiktoken`` finds them several times faster (tests compare the two over every code point). For any other
    vocabulary, one whose PROBES differ, and texts that hold a special token's string, ``tokenizers`` itself is used.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [x["content"] for x in spec.get("added_tokens", []) if x.get("special")] if special else []
        self.letters = _bytes_of_letters()
        self.words = {i: bytes(self.letters[c] for c in w) for w, i in spec["model"]["vocab"].items() if all(c in self.letters for c in w)}
        self.size = size_of(path)
        self.fast = self._fast(spec)
        if any(self.encode(t).tolist() != self.slow.encode(t, add_special_tokens=False).ids for t in PROBES):
            self.fast = None

    def _fast(self, spec: dict):
        model = spec["model"]
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if None in merged or merged != sorted(merged) or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        specials = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {self.words[i]: i for w, i in model["vocab"].items() if i in self.words and w not in specials}
        return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids of the text; none for null. Lone surrogates count as the replacement character."""
        if not text:
            return np.zeros(0, np.uint32)
        text = text.encode("utf-8", "replace").decode()
        if self.fast is None or any(s in text for s in self.specials):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def ends_sentence(self) -> np.ndarray:
        """For each id whether its bytes end a sentence or a line."""
        out = np.zeros(self.size, bool)
        for i, w in self.words.items():
            out[i] = w.endswith((b".", b"!", b"?", b"\n"))
        return out


_KNOWN: dict[tuple[str, bool], Tokens] = {}


def tokens(path: str, special: bool = True) -> Tokens:
    """One instance for each worker process."""
    key = (path, special)
    if key not in _KNOWN:
        _KNOWN[key] = Tokens(path, special)
    return _KNOWN[key]
