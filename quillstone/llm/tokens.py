"""Ids of whole texts by the tokenizers library, at the cost of encoding each distinct word once a worker.

Both vocabularies split a text before they merge, and never across the places used here: blanks and line
ends. So the ids of a text are those of its pieces, which are remembered; the library encodes new pieces in
batches. Texts with other white space are cut by a pattern that mirrors the vocabulary's own.
"""

from __future__ import annotations

import os
import re
from array import array

#: White space to the library's patterns (Unicode's property), as fixed values.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
OTHERS = [c for c in BLANKS if c not in " \n"]
CUT = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]")
ODD = re.compile("[\x1c-\x1f]")
WORDS = re.compile(f"[^{BLANKS}]+")
#: Pieces remembered before a worker starts anew; most pieces of a large corpus never come again.
REMEMBER = 800_000
#: Letters whose class and case no version of Unicode changes: pieces of these alone go straight to the merges.
PLAIN = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")
_loaded: dict[str, Encoder] = {}


def _load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    out, more = [], 256
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if prints else more))
        more += not prints
    return out


ALPHABET = {b: c for b, c in enumerate(byte_alphabet())}


class Encoder:
    """spaced: a blank belongs to the piece that follows it (byte-level vocabularies); else white space is dropped."""

    def __init__(self, name: str) -> None:
        self.tokenizer = _load(name)
        self.spaced = self.tokenizer.normalizer is None
        self.memo: dict[str, bytes] = {}
        self.most = REMEMBER
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _pieces(self, text: str) -> list[str]:
        """Keys of the memo: a piece with one character before it, " " if it stands as it is and none if a blank precedes it.

        No piece after a blank begins with a blank, so keys don't clash. Without `spaced` a piece is its own key.
        """
        if self.spaced:
            if not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in OTHERS)):
                first, *rest = text.replace("\n", " \n").split(" ")
                return [" " + first, *rest] if first else rest
            return [" " + p for p in CUT.findall(text)]
        return WORDS.findall(text) if ODD.search(text) else text.split()

    def _text(self, key: str) -> str:
        """What the library is asked to encode for a key."""
        if not self.spaced or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == " " else " " + key

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        """Words of plain letters, with a full stop or comma or none, need one call of the merges; the library encodes all else."""
        memo, tokenize = self.memo, self.tokenizer.model.tokenize
        stop, comma, line = self._encode([".", ",", "\n"])
        ends, rest = {".": stop, ",": comma}, []
        for k in missing:
            before, lead, w = b"", "", k
            if self.spaced:
                first = k[:1]
                if first == "\n":
                    before, w = line, k[1:]
                elif first == " ":
                    w = k[1:]
                    if w[:1] == " ":
                        lead, w = "\u0120", w[1:]
                else:
                    lead = "\u0120"
            end = ends.get(w[-1:])
            if end is not None:
                w = w[:-1]
            if w.isascii() and w.isalpha():
                mapped = w if self.spaced else w.lower()
            elif PLAIN.fullmatch(w):
                mapped = (w if self.spaced else w.lower()).encode().decode("latin-1").translate(ALPHABET)
            else:
                rest.append(k)
                continue
            bare = memo.get(w) if lead or not self.spaced else None
            if bare is None:
                bare = array("I", [t.id for t in tokenize(lead + mapped)]).tobytes()
                if lead or not self.spaced:
                    memo[w] = bare
            memo[k] = before + bare + (end or b"")
        memo.update(zip(rest, self._encode(list(map(self._text, rest))), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            cut = [self._pieces(t or "") for t in texts[at : at + 512]]
            memo = self.memo
            missing = set().union(*cut).difference(memo)
            if missing:
                if len(memo) + len(missing) > self.most:
                    memo.clear()
                    missing = set().union(*cut)
                self._learn(missing)
            get = self.memo.__getitem__
            for t, ks in zip(texts[at : at + 512], cut, strict=True):
                if t and any(s in t for s in self.special):
                    out += self._encode([t])  # a special token's text may span pieces
                else:
                    out.append(b"".join(map(get, ks)))
        return out


def encoder(name: str) -> Encoder:
    if name not in _loaded:
        _loaded[name] = Encoder(name)
    return _loaded[name]
