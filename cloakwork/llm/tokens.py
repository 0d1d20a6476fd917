"""Token ids of whole texts, by the tokenizers library, with each distinct word encoded once per worker.

Both public vocabularies used here never join what lies on two sides of a white-space run's start, so ids of a text are
those of its parts in order: of its words (white space is dropped), or of its words with the white space before them.
Parts of a plain form are encoded a thousand at a time as one text, whose ids are cut where the vocabulary shows a word's end or
beginning. A text with other white space than space, tab and line ends is encoded as a whole, because there all that needn't hold.
"""

from __future__ import annotations

import gc
import os
import re
from dataclasses import dataclass
from itertools import compress, repeat
from operator import is_

import numpy as np

# white space other than space, tab and line ends
_ODD = "\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_WIDE = _ODD + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACED = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall
#: Where none of these is, each space and each line end begins a part.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\0")


def _spaced(text: str) -> list[str]:
    if any(map(text.__contains__, _RUNS)):
        return _SPACED(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


_PARTS = {"words": str.split, "spaced": _spaced}


# Latin letters, and punctuation that ends a word of them; an apostrophe could begin a contraction
_LETTERS, _CLOSING = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
#: Forms of parts that stand for themselves in a longer text, each with the number of edges that its ids show.
_PLAIN = {
    "words": [(re.compile(_LETTERS), 1), (re.compile(_LETTERS + _CLOSING), 2)],
    "spaced": [(re.compile(f" {_LETTERS}(?:{_CLOSING})?"), 1)],
}
#: What comes between such parts, and which ids show an edge: a word's last one, or its first one.
_EDGES = {"words": (" ", lambda token: token.endswith("</w>")), "spaced": ("", lambda token: token.startswith("Ġ"))}


def _lower(text: str) -> str:
    """Latin texts in lower case, as the vocabulary of words has them anyway; others as they are."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


#: Distinct parts that a worker remembers, and the longest that it does; then it starts anew.
REMEMBERED, LONGEST = 1_600_000, 64
_encoders: dict[tuple, Encoder] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file, how its texts may be cut (``words``, ``spaced``, or None: not at all), and the id that ends a text."""

    path: str
    parts: str | None
    end: int

    def encoder(self) -> Encoder:
        """This process's encoder."""
        key = (self.path, self.parts)
        if key not in _encoders:
            _encoders[key] = Encoder(self)
        return _encoders[key]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.kind_of_parts = vocabulary.parts
        self.parts = _PARTS.get(vocabulary.parts)
        self.known: dict[str, bytes] = {}
        if self.parts is not None:
            self.between, shows = _EDGES[vocabulary.parts]
            self.edge = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.edge[[i for token, i in self.tokenizer.get_vocab().items() if shows(token)]] = True

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part."""
        out: dict[str, bytes] = {"": b""}
        for form, edges in _PLAIN[self.kind_of_parts]:
            fits = form.fullmatch
            self._learn_plain([p for p in parts if fits(p)], edges, out)
        self._learn_parts([p for p in parts if p not in out], out)
        return out

    def _learn_plain(self, parts: list[str], edges: int, out: dict[str, bytes]) -> None:
        """Ids of parts of a plain form, a thousand at a time in one text."""
        width = self.kind.itemsize
        chunks = [parts[at : at + 1000] for at in range(0, len(parts), 1000)]
        texts = [self.between.join(chunk) for chunk in chunks]
        for chunk, got in zip(chunks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, self.kind)
            shown = np.flatnonzero(self.edge[ids])
            if len(shown) != edges * len(chunk):
                continue  # not so plain after all
            ends = shown[edges - 1 :: edges] + 1 if self.kind_of_parts == "words" else np.append(shown[1:], len(ids))
            raw, low = ids.tobytes(), 0
            for part, high in zip(chunk, (ends * width).tolist()):
                out[part] = raw[low:high]
                low = high

    def _learn_parts(self, parts: list[str], out: dict[str, bytes]) -> None:
        """Ids of any parts, many in one call."""
        width = self.kind.itemsize
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(got.ids, self.kind).tobytes()
            ends = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some)), side="right") * width
            low = 0
            for part, high in zip(some, ends.tolist()):
                out[part] = raw[low:high]
                low = high

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        # what is remembered holds no cycles, and looking for some in it again and again takes long
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.parts is None:
            return [self.whole(t) for t in texts]
        out = []
        for at in range(0, len(texts), 256):
            rows = [self._looked_up(text) for text in texts[at : at + 256]]
            new = list(set().union(*[unknown for _, _, unknown in rows]))
            fresh = self._learn(new) if new else {}
            for text, (found, places, unknown) in zip(texts[at : at + 256], rows):
                if found is None:
                    out.append(self.whole(text))
                    continue
                for i, part in zip(places, unknown):
                    found[i] = fresh[part]
                out.append(b"".join(found))
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known = {}
            self.known.update((part, ids) for part, ids in fresh.items() if len(part) <= LONGEST)
        return out

    def _looked_up(self, text: str) -> tuple[list | None, list[int], list[str]]:
        """What is known of a text's parts, and places and parts that are not; None if the text must stay whole."""
        if any(map(text.__contains__, _ODD if text.isascii() else _ODD_WIDE)):
            return None, [], []
        parts = self.parts(_lower(text) if self.kind_of_parts == "words" else text)
        found = list(map(self.known.get, parts))
        missing = list(map(is_, found, repeat(None)))
        return found, list(compress(range(len(parts)), missing)), list(compress(parts, missing))
