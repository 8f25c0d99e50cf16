"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE gives. It starts
as one state with an arc for each base symbol. Each merge (u, v) -> w, in order of priority,
adds a gadget: wherever an arc u leads to a state with an arc v, u is led to a copy of that
state without the arc v, and an arc w leads to where v led. After any token there is one
state, so a merge adds at most one state, and states are stored as (copied from, arc taken
away, merge). A word is encoded by running all of its segmentations through the automaton at
once, from left to right: at each place only one token can end a prefix that is accepted,
and it is found by table lookups among the vocabulary's suffixes there. Decoding emits the
label of each arc.

Text is pre-split as the tokenizer file says (normalise, split, bytes as letters, an end
mark on each word's last letter); special tokens in a text stay whole.

Defined cases: null text reads as empty; an empty text has no ids and decodes to an empty
string; repeated rows are encoded each; empty input gives empty output; a tokenizer file that asks for
what isn't done here is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import HELD, id_and_text, lean

#: Words whose encoding a worker keeps, in each of two generations.
CACHED_WORDS = 100_000
#: Steps, and pairs of tokens, that an automaton keeps beside its tables.
CACHED_STEPS = 500_000

#: What the splitter's pattern means by white space.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Automaton:
    """Tokens are ids; state 0 is the start, with an arc for each token.

    letters gives the symbol of each letter; the same letter with the end mark is symbol + 256.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: list[str], suffix: str = ""):
        size = max(vocab.values(), default=-1) + 1
        self.left, self.born = [-1] * size, [-1] * size
        self.after = [0] * size
        self.copied, self.gone, self.made = [0], [-1], [-1]
        self.dead: set[int] = set()
        made: set[int] = set()
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab.get(a), vocab.get(b), vocab.get(a + b)
            if u is not None and v is not None and w is not None and w not in made:
                self._gadget(k, u, v, w)
                made.add(w)
        self.known: dict[int, bool] = {}
        self._suffixes(vocab, made, {c: i for i, c in enumerate(letters)}, suffix)

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        q, r = self.after[u], self.after[v]
        if u in self.dead or v in self.dead or not self.arc(q, v):
            self.dead.add(w)
            return
        self.copied.append(q)
        self.gone.append(v)
        self.made.append(k)
        self.after[u] = len(self.copied) - 1
        self.left[w], self.born[w], self.after[w] = u, k, r

    def arc(self, state: int, t: int) -> bool:
        """Whether the state has an arc t. An arc w of a merge stands wherever its left token's did then."""
        copied, gone, made, left, born = self.copied, self.gone, self.made, self.left, self.born
        while state:
            if born[t] >= made[state]:
                t = left[t]
            elif t == gone[state]:
                return False
            else:
                state = copied[state]
        return True

    def _suffixes(self, vocab: dict[str, int], made: set[int], symbol: dict[str, int], suffix: str) -> None:
        """Tables over the tokens' symbols: step (node, symbol) -> node; at a node, the longest token
        that ends there; for each token, its length and the next shorter token that ends with it."""
        self.step: dict[int, int] = {}
        self.back, self.longest = [0], [-1]
        self.length, self.shorter = [0] * len(self.after), [-1] * len(self.after)
        own, nodes = [-1], [(0, 0, 0)]
        for s, t in vocab.items():
            plain, end = (s[: -len(suffix)], 256) if suffix and s.endswith(suffix) and len(s) > len(suffix) else (s, 0)
            if t in self.dead or t not in made and len(plain) != 1 or not all(c in symbol for c in plain):
                continue
            node = 0
            for i, c in enumerate(plain):
                at = node << 9 | symbol[c] + (end if i == len(plain) - 1 else 0)
                if (to := self.step.get(at)) is None:
                    to = self.step[at] = len(nodes)
                    nodes.append((node, at & 511, i + 1))
                    own.append(-1)
                node = to
            own[node], self.length[t] = t, len(plain)
        self.back, self.longest = [0] * len(nodes), own[:]
        for node in sorted(range(1, len(nodes)), key=lambda x: nodes[x][2]):
            parent, c, depth = nodes[node]
            b = self.back[parent]
            while depth > 1 and b and b << 9 | c not in self.step:
                b = self.back[b]
            self.back[node] = self.step.get(b << 9 | c, 0) if depth > 1 else 0
            below = self.longest[self.back[node]]
            if own[node] >= 0:
                self.shorter[own[node]] = below
            else:
                self.longest[node] = below
        self.jump: dict[int, int] = dict(self.step)

    def _jump(self, at: int) -> int:
        node, c = at >> 9, at & 511
        while node and node << 9 | c not in self.step:
            node = self.back[node]
        to = self.jump[at] = self.step.get(node << 9 | c, 0)
        return to

    def encode(self, symbols: list[int]) -> list[int]:
        """Ids of one word's symbols."""
        jump, longest, length, shorter, known, after = self.jump, self.longest, self.length, self.shorter, self.known, self.after
        node, shift, ends = 0, len(after), [-1]
        for i, c in enumerate(symbols, 1):
            at = node << 9 | c
            node = jump.get(at)
            if node is None:
                node = self._jump(at)
            t = longest[node]
            while t >= 0:
                before = ends[i - length[t]]
                if before < 0:
                    if i == length[t]:
                        break
                else:
                    pair = after[before] * shift + t
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = self.arc(after[before], t)
                    if ok:
                        break
                t = shorter[t]
            ends.append(t)
        out, i = [], len(symbols)
        while i:
            t = ends[i]
            if t < 0:
                raise ValueError("a letter has no token")
            out.append(t)
            i -= length[t]
        if len(known) > CACHED_STEPS:
            known.clear()
        if len(jump) > len(self.step) + CACHED_STEPS:
            self.jump = dict(self.step)
        out.reverse()
        return out


def supported(spec: dict) -> None:
    """Raises ValueError if a tokenizer file asks for what this codec doesn't do."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"the tokenizer file has {what}, which isn't supported")

    model, normal, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    need(model.get("type", "BPE") == "BPE", "another model than BPE")
    for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"):
        need(not model.get(k), k)
    need([n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"], "another normaliser than NFC, white space and lower case")
    white = next(n for n in normal["normalizers"] if n["type"] == "Replace")
    need(white["pattern"] == {"Regex": r"\s+"} and white["content"] == " ", "another replacement than that of white space")
    parts = pre.get("pretokenizers", [])
    need([p["type"] for p in parts] == ["Split", "ByteLevel"], "another splitter than a pattern and bytes")
    need(parts[0]["behavior"] == "Removed" and parts[0]["invert"] and "Regex" in parts[0]["pattern"], "a splitter that keeps what lies between matches")
    need(not parts[1].get("add_prefix_space") and not parts[1].get("use_regex"), "a second splitter")
    need(not spec.get("decoder") and not spec.get("post_processor"), "a decoder or a post-processor")
    for t in spec.get("added_tokens", []):
        need(not any(t.get(k) for k in ("normalized", "lstrip", "rstrip", "single_word")) and bool(t["content"]), f"the added token {t['content']!r} with flags")


class Codec:
    """What a tokenizer file describes: normaliser, splitter, automaton, labels."""

    def __init__(self, text: str):
        spec = json.loads(text)
        supported(spec)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.mark = 256 if suffix else 0
        self.automaton = Automaton(model["vocab"], merges, byte_letters(), suffix)
        self.labels = {i: s for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: s for s, i in self.special.items()}
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: What all special tokens begin with.
        self.begin = os.path.commonprefix([*self.special])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", "[^" + _SPACE))
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def normal(text: str) -> str:
        # each white space character counts as a separator only, so runs needn't be made single
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def word_ids(self, piece: str) -> list[int]:
        symbols = list(piece.encode())
        symbols[-1] += self.mark
        return self.automaton.encode(symbols)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.around.split(text) if self.around and self.begin in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in self.pieces.findall(self.normal(part)):
                    out += self.word_ids(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, with a space between, as a tokenizer without a decoder joins them."""
        return " ".join([self.labels[i] for i in ids if i in self.labels])

    def both(self, text: str) -> tuple[int, str, str]:
        """Number of ids, decimal ids joined by a space, decoded text: a word's are kept for its next places."""
        words, n, ids, labels = self.words, 0, [], []
        for part in self.around.split(text) if self.around and self.begin in text else [text]:
            if part in self.special:
                found = [self._of([self.special[part]])]
            else:
                found = []
                for piece in self.pieces.findall(self.normal(part)):
                    w = words.get(piece)
                    if w is None:
                        w = self.older.get(piece) or self._of(self.word_ids(piece))
                        if len(piece) <= 64:
                            if len(words) >= CACHED_WORDS:
                                self.older, self.words = words, {}
                                words = self.words
                            words[piece] = w
                    found.append(w)
            n += sum([w[0] for w in found])
            ids += [w[1] for w in found]
            labels += [w[2] for w in found]
        return n, " ".join(ids), " ".join(labels)

    def _of(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)


_CODECS: dict[str, Codec] = HELD.setdefault("bpe", {})


def codec(text: str) -> Codec:
    """The worker's own codec of a tokenizer file's text."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def _sent(docs: DataFrame, path: str):
    """The file's text, sent to each executor once; a tokenizer file is a few MB whatever the input."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_text())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for b in lean(batches, "bpe"):
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the decoded text of encode()'s rows."""
    sent = _sent(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        for b in lean(batches, "bpe"):
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(i or []) for i in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and then decoding each text."""
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in lean(batches, "bpe"):
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = []
                for t in part.column(1).to_pylist():
                    n, ids, text = c.both(t or "")
                    found.append((n, sha(ids), sha(text)))
                columns = [part.column(0), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
