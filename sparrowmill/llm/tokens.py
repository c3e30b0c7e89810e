"""Public tokenizers in Python workers: each worker loads a vocabulary once and keeps what it has encoded, within a bound."""

from __future__ import annotations

import base64
import os
import unicodedata

import numpy as np

_loaded: dict[tuple, object] = {}


def once(make, *args):
    """make(*args), kept by worker."""
    key = (make.__name__, *args)
    if key not in _loaded:
        _loaded[key] = make(*args)
    return _loaded[key]


class WordBpe:
    """Ids of a word-level BPE vocabulary file, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    The file's splitter never lets a token cross white space and looks at nothing beyond a match, so a text's ids are
    those of its stretches between white space, one after the other; stretches recur and are kept. Texts that hold a
    special token's opening or a control character on which Python and the splitter disagree go through the
    library whole.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.whole = Tokenizer.from_file(path)
        self.part = Tokenizer.from_file(path)
        self.part.normalizer = normalizers.Sequence([])
        self.keep, self.known = keep, {}
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def stretches(self, text: str) -> list[str] | None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        return text.split()

    def _learn(self, new: list[str]) -> None:
        """Adds stretches: letters and what follows them apart; words of letters alone go to the library by the thousand,
        as one text, and are told apart by the ids that end a word."""
        letters, odd, split = set(), [], []
        for x in new:
            core = x.rstrip(".,;:!?")
            if core.isalpha():
                letters.add(core)
                if core != x:
                    split.append((x, core, x[len(core) :]))
            else:
                odd.append(x)
        odd.extend({t for _, _, t in split}.difference(self.known, odd))
        words = list(letters.difference(self.known))
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.part.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            raw = ids.tobytes()
            begin = 0
            for w, end in zip(some, stop.tolist()):
                self.known[w] = raw[4 * begin : 4 * end]
                begin = end
        for w, e in zip(odd, self.part.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()
        for x, core, tail in split:
            self.known[x] = self.known[core] + self.known[tail]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.stretches(t) for t in texts]
        new = set().union(*(p for p in parts if p is not None)).difference(self.known)
        if len(self.known) + len(new) > self.keep:
            self.known = {}
            new = set().union(*(p for p in parts if p is not None))
        self._learn(list(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), "<u4") if p is not None else np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, parts)]


def word_bpe(path: str) -> WordBpe:
    return once(WordBpe, path)


def _byte_bpe(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_bpe(path: str, pattern: str):
    return once(_byte_bpe, path, pattern)
