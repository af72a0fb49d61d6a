"""Token ids of whole texts from a byte-level BPE vocabulary file, as little-endian 32-bit integers.

The vocabulary's own library makes all ids. Its pre-tokens always end where white space follows
another character, and where line ends do other than white space, so the stretches between such
places are encoded once in a worker and then looked up; so is a word without the signs that follow
it. Texts in which spaces or line ends meet other white space, or that spell a special token, go
to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

# of several line ends the last is a pre-token of its own, unless the text ends there
STRETCH = re.compile(r"\n+\Z|\n+(?=\n)|\n| *[^ \n]+| +\Z")
UNSAFE = re.compile(r"[^\S ] | \n|[^\S\n ]\n|\n[^\S\n]")
OTHER_SPACE = re.compile(r"[^\S \n]")
SIGNED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s']+)")
#: Stretches that a worker keeps, the first it meets; a longer one is not kept. Stretches encoded in one call.
KEPT, LONGEST, AT_ONCE = 800_000, 64, 200


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        size = self.library.get_vocab_size()
        # a letter of a byte-level token stands for one byte
        self.bytes = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.seen: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _joined(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches that end without white space, encoded as one text and cut by their bytes."""
        apart = [s if s[0] == " " else "\n" + s for s in stretches]
        found = self.library.encode_batch_fast(["".join(apart)], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype="<u4")
        upto = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(s.encode()) for s in apart])) + 1
        raw, upto = ids.tobytes(), (4 * upto).tolist()
        # the line end in front of a stretch is an id of its own
        start = [a if s[0] == " " else a + 4 for a, s in zip([0, *upto[:-1]], apart, strict=True)]
        return [raw[a:b] for a, b in zip(start, upto, strict=True)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        halves = {s: m.groups() for s, m in ((s, SIGNED.fullmatch(s)) for s in new) if m}
        wanted = (new - halves.keys()) | {x for pair in halves.values() for x in pair if x not in self.seen}
        plain = [s for s in wanted if (s[0] == " " or not s[0].isspace()) and not s[-1].isspace()]
        rest = list(wanted.difference(plain))
        out = dict(zip(rest, self._ids(rest), strict=True))
        for i in range(0, len(plain), AT_ONCE):
            part = plain[i : i + AT_ONCE]
            out.update(zip(part, self._joined(part), strict=True))
        ids_of = lambda x: self.seen[x] if x in self.seen else out[x]
        out.update((s, ids_of(a) + ids_of(b)) for s, (a, b) in halves.items())
        return out

    def _whole(self, text: str) -> bool:
        if "\n " in text or " \n" in text or OTHER_SPACE.search(text) and UNSAFE.search(text):
            return True
        return bool(self.special.search(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null counts as empty."""
        seen = self.seen
        cut = [[] if not t else [t] if self._whole(t) else STRETCH.findall(t) for t in texts]
        parts = [list(map(seen.get, c)) for c in cut]
        lacking = [i for i, p in enumerate(parts) if None in p]
        if lacking:
            new = self._learn({s for i in lacking for s, p in zip(cut[i], parts[i], strict=True) if p is None})
            for i in lacking:
                parts[i] = [new[s] if p is None else p for s, p in zip(cut[i], parts[i], strict=True)]
            if len(seen) < KEPT:
                seen.update((s, ids) for s, ids in new.items() if len(s) <= LONGEST)
        return [b"".join(p) for p in parts]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)
