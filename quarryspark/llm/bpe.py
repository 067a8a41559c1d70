"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding. A token sequence is the BPE encoding of a string exactly when each neighbouring pair is
(the encoding of the pair's own text is that pair). So the transducer keeps, for each prefix of what
it has read, the last token of that prefix's encoding: the one suffix token that is compatible with
the last token of what precedes it. Every word goes through it, symbol by symbol.

Lookahead. Let a prefix and a longer text be merged side by side, rank by rank. Their token rows can
differ only from some frontier on, first the prefix's end. A merge of rank r moves the frontier left
over its left part; the next such merge has a higher rank and a right part that starts with the token
passed before. So the frontier moves at most as far as the left parts of the longest such chain of
merges reach, and ``sufficient_lookahead`` finds that by one pass over the ranked list (866 symbols for the
49k list). Tokens that end further back than that are stable: they are emitted and forgotten, so the
transducer's window never exceeds the lookahead, two tokens and a step.

Decoding is an incremental state machine too: token strings are joined (a file without a decoder), or
its byte alphabet is turned back into UTF-8 with the bytes of an unfinished character as the state.

Words never reach over white space, so texts are cut there into runs. The distinct words of a piece of
texts are read side by side (``WordTable``): step i reads symbol i of every word, and what a step needs
of the vocabulary and of compatible pairs comes from tables. A word of over ``LONG`` characters is fed to
its own ``WordTransducer`` as a stream. What workers remember of token pairs is bounded. Character
classes come from the tokenizers library itself, read once on the driver.

Edge cases: null texts count as empty; an empty text has no tokens and decodes to the empty string;
long texts are read in pieces cut at white space, and runs of over ``LONG`` characters as a stream, so
that memory beyond the text itself does not follow their length; special-token strings in a text
become their ids, as in the tokenizers library with its default settings; repeated rows give
repeated results, null and repeated ids stay as they are; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np

from quarryspark.llm.common import larger, released, short_batches, trim_memory

#: Fixed value of the lower-casing BPE files: contractions that are words of their own.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
#: Pairs of tokens that a stream remembers, and slots (a power of 2) of the table in which steps look them up; half of them are used.
PAIRS, SLOTS = 50_000, 1 << 20
#: Bytes of text looked at together; characters from which a run is read as a stream; symbols between two looks for stable tokens.
PIECE, LONG, STEP = 1 << 22, 1 << 16, 512


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@functools.cache
def character_classes() -> dict[str, str]:
    """Letters, numbers and white space as ranges of a regular expression's set, as the tokenizers library has them."""
    from tokenizers import Regex, pre_tokenizers

    found = {}
    for name, kind in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
        cut = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
        ranges = []
        for low in range(0, 0x110000, 0x10000):  # plane by plane
            points = [c for c in range(low, low + 0x10000) if not 0xD800 <= c < 0xE000]
            for _, (a, b) in cut.pre_tokenize_str("".join(map(chr, points))):
                at = a
                while at < b:  # a run of places is a run of code points but for the surrogates' gap
                    end = b if points[b - 1] - points[at] == b - 1 - at else next(k for k in range(at, b) if points[k] - points[at] != k - at)
                    ranges.append((points[at], points[end - 1]))
                    at = end
        found[name] = "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in ranges)
    return found


class Merges:
    """A vocabulary and its ranked merge list, with the word-end mark as a part of the last symbol."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        own = {t: t for t in self.vocab}  # one string for each token, wherever it stands
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank: dict[tuple[str, str], int] = {(own.get(a, a), own.get(b, b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(len(self.symbols(t)) for t in self.vocab)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.has_decoder = spec.get("decoder") is not None
        self.lookahead = self.sufficient_lookahead()
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def bare(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) and len(token) > len(self.end) else token

    def symbols(self, token: str) -> list[str]:
        body = self.bare(token)
        return list(token) if body is token else [*body[:-1], body[-1] + self.end]

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short symbol list: lowest rank first, leftmost first."""
        out, rank = list(symbols), self.rank
        while len(out) > 1:
            at, best = -1, len(rank)
            for i in range(len(out) - 1):
                r = rank.get((out[i], out[i + 1]), best)
                if r < best:
                    at, best = i, r
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def own_encoding(self, left: str, right: str) -> bool:
        """Whether the two tokens, side by side, are their own encoding. left '': right alone."""
        parts = [left, right] if left else [right]
        return self.merged([s for p in parts for s in self.symbols(p)]) == parts

    def compatible(self, left: str, right: str) -> bool:
        """``own_encoding``, remembered."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.own_encoding(left, right)
        return known

    def sufficient_lookahead(self) -> int | None:
        """Symbols after which a token can't change; None if the list isn't in the order in which its tokens come to be."""
        made, reach, most = set(), {}, 0
        for left, right in self.rank:
            body = self.bare(right)
            if any(len(self.symbols(t)) > 1 and t not in made for t in (left, right)):
                return None
            made.add(left + right)
            here = len(left) + max((reach.get(body[:i], 0) for i in range(1, len(body) + 1)), default=0)
            reach[left] = max(reach.get(left, 0), here)
            most = max(most, here)
        return most


class WordTransducer:
    """Reads one word's symbols and emits its tokens as soon as they are stable."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.text = ""  # symbols that were read and not yet emitted
        self.last: list[str] = []  # last token of the encoding of each prefix of ``text``
        self.before = ""  # the token emitted last
        self.widest = 0

    def _read(self, symbols: str, end: str) -> None:
        m, last, before = self.m, self.last, self.before
        vocab, pairs, longest, compatible = m.vocab, m.pairs, m.longest, m.compatible
        at = len(self.text)
        self.text = text = self.text + symbols
        for i in range(at + 1, len(text) + 1):
            for start in range(i - longest if i > longest else 0, i):
                token = text[start:i] + end
                if token in vocab:
                    left = last[start - 1] if start else before
                    fits = pairs.get((left, token))
                    if fits or fits is None and compatible(left, token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"the vocabulary lacks the symbol {text[i - 1] + end!r}")

    def _path(self, i: int, end: str = "") -> list[str]:
        """The tokens of text[:i], whose last token may carry the word's end."""
        out, cut = [], len(end)
        while i:
            token = self.last[i - 1]
            out.append(token)
            i -= len(token) - cut
            cut = 0
        out.reverse()
        return out

    def feed(self, symbols: str) -> list[str]:
        """Symbols that are not the word's last; returns the tokens that became stable."""
        out: list[str] = []
        for at in range(0, len(symbols), STEP):
            self._read(symbols[at : at + STEP], "")
            self.widest = max(self.widest, len(self.text))
            if self.m.lookahead is not None and len(self.text) > self.m.lookahead + self.m.longest:
                out += self._stable()
        return out

    def _stable(self) -> list[str]:
        cut = len(self.text)
        while cut > len(self.text) - self.m.lookahead and cut:
            cut -= len(self.last[cut - 1])
        if not cut:
            return []
        out = self._path(cut)
        self.before, self.text, self.last = out[-1], self.text[cut:], self.last[cut:]
        return out

    def finish(self, symbol: str) -> list[str]:
        """The word's last symbol; returns the rest of the tokens."""
        self._read(symbol, self.m.end)
        return self._path(len(self.text), self.m.end)


class WordTable:
    """The transducer for many words at once: step i reads symbol i of every word.

    Substrings are found in the vocabulary by a 64-bit hash; the tokens found are held against the words' bytes at the
    end, and a word that fails (a collision) goes through its own transducer.
    """

    def __init__(self, merges: Merges, bytes_of: dict[str, int]):
        self.m, self.size = merges, max(merges.text_of) + 1
        rng = np.random.default_rng(17)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.tokens: list[str | None] = [None] * self.size
        spelled: dict[int, bytes] = {}
        kinds: tuple[dict[int, int], dict[int, int]] = ({}, {})  # hash -> id, of tokens inside a word and at its end
        for token, k in merges.vocab.items():
            body = merges.bare(token)
            if all(c in bytes_of for c in body):
                spelled[k], self.tokens[k] = bytes(bytes_of[c] for c in body), token
                kinds[body is not token][self._hash(spelled[k])] = k
        if not merges.end:
            kinds = (kinds[0], kinds[0])
        self.found = [self._hashed(kind) for kind in kinds]
        self.length = np.zeros(self.size, np.int64)
        for k, b in spelled.items():
            self.length[k] = len(b)
        self.starts = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(spelled.get(k, b"") for k in range(self.size)), np.uint8)
        self.pair_key, self.pair_fits, self.pairs = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool), 0

    def _hash(self, b: bytes) -> int:
        h, power = 0, 1
        for c in b:
            h, power = (h + int(self.value[c]) * power) % (1 << 64), power * self.base % (1 << 64)
        return h

    def _hashed(self, kind: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a filter by 22 bits; whether a slot by 17 bits is taken, its key, its id); a key that finds its slot taken goes to the next free one."""
        room = (1 << 17) + len(kind)
        seen, taken, keys, ids = np.zeros(1 << 22, bool), np.zeros(room + 1, bool), np.zeros(room + 1, np.uint64), np.zeros(room + 1, np.int64)
        for h, k in kind.items():
            slot = int(self._slot(np.array([h], np.uint64), 22)[0])
            at = slot >> 5
            while taken[at]:
                at += 1
            seen[slot], taken[at], keys[at], ids[at] = True, True, h, k
        return seen, taken, keys, ids

    @staticmethod
    def _slot(h: np.ndarray, bits: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            of = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, b, np.uint64)]))
            self.powers, self.inverses = of(self.base), of(pow(self.base, -1, 1 << 64))

    def _occurrences(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(place, length, id) of every vocabulary token in the words: inside ones, then those that end a word."""
        self._grow(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.powers[: len(data)])])
        left = np.repeat(ends, ends - starts) - np.arange(len(data))
        at, out = np.arange(len(data)), ([], [])
        for n in range(1, self.m.longest + 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            h = (sums[at + n] - sums[at]) * self.inverses[at]
            slot, final = self._slot(h, 22), left[at] == n
            for kind, here in ((0, ~final), (1, final)):
                seen, taken, keys, ids = self.found[kind]
                here = np.flatnonzero(here & seen[slot])
                k = slot[here] >> 5
                while len(here):
                    full = taken[k]
                    here, k = here[full], k[full]
                    hit = keys[k] == h[here]
                    out[kind].append((at[here[hit]], np.full(int(hit.sum()), n), ids[k[hit]]))
                    here, k = here[~hit], k[~hit] + 1
        cat = lambda x: [np.concatenate(c) for c in zip(*x)] if x else [np.zeros(0, np.int64)] * 3
        return cat(out[0]), cat(out[1])

    def _fits(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the pairs are their own encoding; left ``size``: the token begins the word."""
        key = left * (self.size + 1) + token
        fits, place, rest = np.zeros(len(key), bool), self._slot(key.view(np.uint64), SLOTS.bit_length() - 1), np.arange(len(key))
        unknown = []
        while len(rest):
            there = self.pair_key[place[rest]]
            hit = there == key[rest]
            fits[rest[hit]] = self.pair_fits[place[rest[hit]]]
            unknown.append(rest[there == -1])
            rest = rest[~hit & (there != -1)]
            place[rest] = (place[rest] + 1) % SLOTS
        unknown = np.concatenate(unknown) if unknown else rest
        if len(unknown):
            fresh, back = np.unique(key[unknown], return_inverse=True)
            a, b = np.divmod(fresh, self.size + 1)
            names = self.tokens
            found = np.fromiter((self.m.own_encoding(names[x] if x < self.size else "", names[y]) for x, y in zip(a.tolist(), b.tolist())), bool, len(fresh))
            fits[unknown] = found[back]
            self._remember(fresh, found)
        return fits

    def _remember(self, keys: np.ndarray, fits: np.ndarray) -> None:
        if self.pairs + len(keys) > SLOTS // 2:
            self.pair_key[:], self.pairs = -1, 0
        if len(keys) > SLOTS // 2:
            return
        self.pairs += len(keys)
        place = self._slot(keys.view(np.uint64), SLOTS.bit_length() - 1)
        while len(keys):
            free = self.pair_key[place] == -1
            self.pair_key[place[free]] = keys[free]  # of several for one slot, one gets it
            own = self.pair_key[place] == keys
            self.pair_fits[place[own]] = fits[own]
            keys, fits, place = keys[~own], fits[~own], (place[~own] + 1) % SLOTS

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each word, their ids one after the other); data, offsets: the words' bytes. No word is empty."""
        starts, ends = offsets[:-1], offsets[1:]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = np.repeat(starts, ends - starts)
        inside, final = self._occurrences(data, starts, ends)
        last = np.full(len(data), -1, np.int64)  # token of the prefix's encoding that ends with this byte

        def step(at, n, token):
            left = np.where(at == begins[at], self.size, last[at - 1])
            ok = left >= 0
            at, n, token, left = at[ok], n[ok], token[ok], left[ok]
            ok = self._fits(left, token)
            last[at[ok] + n[ok] - 1] = token[ok]

        at, n, token = inside
        symbol = at + n - begins[at]
        order = np.argsort(symbol, kind="stable")
        at, n, token = at[order], n[order], token[order]
        cuts = np.flatnonzero(np.diff(symbol[order])) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            if x < y:
                step(at[x:y], n[x:y], token[x:y])
        step(*final)

        word, place, parts = np.arange(len(starts)), ends.copy(), []
        while len(word):  # from the ends back
            token = last[place - 1]
            ok = token >= 0
            word, place, token = word[ok], place[ok], token[ok]
            parts.append((word, token))
            place = place - self.length[token]
            on = place > starts[word]
            word, place = word[on], place[on]
        word, token = (np.concatenate(x) for x in zip(*parts))
        order = len(word) - 1 - np.argsort(word[::-1], kind="stable")
        word, token = word[order], token[order]
        counts = np.bincount(word, minlength=len(starts))
        return self._checked(data, offsets, counts, token)

    def _checked(self, data, offsets, counts, token):
        lengths = self.length[token]
        spelled = self.bytes[ragged(self.starts[token], lengths)]
        if len(spelled) == len(data) and (spelled == data).all():
            return counts, token
        cuts, out = np.concatenate([[0], np.cumsum(counts)]), []
        names = byte_alphabet()
        for w in range(len(counts)):
            ids, word = token[cuts[w] : cuts[w + 1]], data[offsets[w] : offsets[w + 1]]
            if b"".join(self.bytes[self.starts[k] : self.starts[k + 1]].tobytes() for k in ids.tolist()) != word.tobytes():
                t, symbols = WordTransducer(self.m), "".join(names[c] for c in word.tolist())
                ids = np.array([self.m.vocab[x] for x in (*t.feed(symbols[:-1]), *t.finish(symbols[-1]))], np.int64)
            out.append(ids)
        return np.array([len(x) for x in out], np.int64), np.concatenate(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of starts[0] .. starts[0] + lengths[0], starts[1] and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Encodes and decodes runs, words and whole texts."""

    def __init__(self, merges: Merges, classes: dict[str, str] | None = None):
        from tokenizers import normalizers

        self.m = merges
        c = classes or character_classes()
        self.words = re.compile(f"{CONTRACTIONS}|[{c['L']}]+|[{c['N']}]|[^{c['S']}{c['L']}{c['N']}]+")
        self.kind = np.full(0x110000, 3, np.uint8)  # 0 white space, 1 letter, 2 number, 3 other
        for kind, name in enumerate("SLN"):
            for x, y in re.findall(r"\\U(\w{8})-\\U(\w{8})", c[name]):
                self.kind[int(x, 16) : int(y, 16) + 1] = kind
        self.special = re.compile("(" + "|".join(map(re.escape, merges.special)) + ")") if merges.special else None
        self.alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.table = WordTable(merges, self.bytes_of)

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.alphabet.__getitem__, word.encode("utf-8")))

    def stream_word(self, word: str) -> Iterator[int]:
        t, vocab = WordTransducer(self.m), self.m.vocab
        for at in range(0, len(word) - 1, STEP):
            for x in t.feed(self.symbols(word[at : min(at + STEP, len(word) - 1)])):
                yield vocab[x]
        symbols = self.symbols(word[-1])
        for x in (*t.feed(symbols[:-1]), *t.finish(symbols[-1])):
            yield vocab[x]

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the words of normalised text, their offsets, number of line ends before each)."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        inside = kind > 0
        begins = inside & (kind == 2)
        begins[1:] |= inside[1:] & (kind[1:] != kind[:-1])
        begins[:1] |= inside[:1]
        # contractions are words of their own where an apostrophe begins a word
        padded = np.concatenate([points, [10, 10, 10]])
        for k in np.flatnonzero(begins & (points == 39)).tolist():
            one, two = chr(padded[k + 1]), chr(padded[k + 1]) + chr(padded[k + 2])
            size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if size:
                begins[k + 1] = False
                if k + size < len(points):
                    begins[k + size] = inside[k + size]
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        data = np.frombuffer(text.encode("utf-8"), np.uint8)[np.repeat(inside, sizes)]
        ends = np.cumsum(np.where(inside, sizes, 0))
        first = np.flatnonzero(begins)
        offsets = np.concatenate([ends[first] - sizes[first], ends[-1:] if len(first) else [0]])
        return data, offsets, np.cumsum(points == 10)[first]

    def encode_runs(self, runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where a run's ids begin, how many they are, ids) of an Arrow array of runs without white space of the six kinds."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = np.zeros(len(runs), bool)
        for content in self.m.special:
            odd |= pc.match_substring(runs, content).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", runs) if odd.any() else runs
        text = self.normalised(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py())
        data, offsets, run = self._words(text)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        own = words.dictionary
        own_at = np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1].astype(np.int64)
        counts, ids = self.table.encode(np.frombuffer(own.buffers()[2] or b"", np.uint8)[: own_at[-1]], own_at)
        begin, code = np.concatenate([[0], np.cumsum(counts)]), words.indices.to_numpy(zero_copy_only=False)
        flat = ids[ragged(begin[code], counts[code])]
        size = np.bincount(run, counts[code], len(runs)).astype(np.int64) if len(run) else np.zeros(len(runs), np.int64)
        starts = np.cumsum(size) - size
        for k in np.flatnonzero(odd).tolist():
            special = self.encode_run(runs[k].as_py())
            starts[k], size[k] = len(flat), len(special)
            flat = np.concatenate([flat, np.array(special, np.int64)])
        return starts, size, flat

    def normalised(self, text: str) -> str:
        return text.lower() if text.isascii() else self.library.normalize_str(text)

    def encode_run(self, run: str) -> tuple[int, ...]:
        return tuple(self.stream_run(run))

    def stream_run(self, run: str) -> Iterator[int]:
        """The ids of a run of any length, as they become stable."""
        for piece in self.special.split(run) if self.special else (run,):
            if piece in self.m.special:
                yield self.m.special[piece]
            else:
                for w in self.words.finditer(self.normalised(piece)):
                    yield from self.stream_word(w.group())

    def encode(self, text: str | None) -> Iterator[int]:
        for run in re.finditer(r"[^ \t-\r]+", text or ""):
            yield from self.stream_run(run.group())

    def decoder(self, joined: bool | None = None) -> Decoder:
        """joined: give token strings between spaces; None: as the tokenizer file has it, that is if it names no decoder."""
        return Decoder(self.m, self.bytes_of, not self.m.has_decoder if joined is None else joined)


class Decoder:
    """Ids to text, one at a time; the state is what an unfinished character still lacks."""

    def __init__(self, merges: Merges, bytes_of: dict[str, int], joined: bool):
        self.m, self.joined, self.first, self.bytes_of = merges, joined, True, bytes_of
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token_id: int) -> str:
        token = self.m.text_of.get(token_id)
        if token is None:
            return ""
        if self.joined:
            out, self.first = token if self.first else " " + token, False
            return out
        if token in self.m.special:
            return self.utf8.decode(b"", True) + token
        body = self.m.bare(token)
        return self.utf8.decode(bytes(self.bytes_of[c] for c in body)) + " " * (body is not token)

    def finish(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


def pieces(column, limit: int = PIECE) -> Iterator[tuple[list[int], object]]:
    """(row numbers, texts) of an Arrow column of strings, in pieces of about ``limit`` bytes at most, cut at white space.

    A run of over ``LONG`` characters is a piece of its own. Rows come in order; a row may go on in the next pieces.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    first = 0
    while first < len(sizes):
        stop = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), limit, "right")))
        long = first + np.flatnonzero(sizes[first:stop] > LONG)  # may hold a long run
        for k in [*long.tolist(), stop]:
            if k > first:
                yield list(range(first, k)), column.slice(first, k - first)
            if k < stop:
                for text in _cut(column[k].as_py(), limit // 4):
                    yield [k], pa.array([text], pa.string())
            first = k + 1 if k < stop else stop


def _cut(text: str, limit: int) -> Iterator[str]:
    at = 0
    for run in re.finditer(rf"[^ \t-\r]{{{LONG + 1},}}", text):
        yield from _parts(text, at, run.start(), limit)
        yield run.group()
        at = run.end()
    yield from _parts(text, at, len(text), limit)


def _parts(text: str, at: int, stop: int, limit: int) -> Iterator[str]:
    while at < stop:
        cut = min(at + limit, stop)
        while cut < stop and text[cut] not in " \t\n\x0b\f\r":  # at most LONG steps
            cut += 1
        yield text[at:cut]
        at = cut


def long_run(texts) -> bool:
    """Whether a piece is one run to be read as a stream."""
    return len(texts) == 1 and len(text := texts[0].as_py()) > LONG and not re.search(r"[ \t-\r]", text)


class Runs:
    """The runs of a piece of texts: distinct ones, which distinct one each is, and where rows begin."""

    def __init__(self, texts):
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        self.offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary

    def counted(self, per_run: np.ndarray) -> np.ndarray:
        """Sum of a number of each run, by row."""
        total = np.concatenate([[0], np.cumsum(per_run[self.codes])])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Digester:
    """(number of tokens, sha256 of the ids, sha256 of the decoded text) of each text of a column."""

    def __init__(self, codec: Codec, piece: int = PIECE):
        import pyarrow as pa

        self.codec, self.piece = codec, piece
        self.join = " " if not codec.m.has_decoder else ""
        names = [codec.m.text_of.get(k, "") for k in range(codec.table.size)]
        self.names, self.numbers = pa.array(names, pa.string()), pa.array([str(k) for k in range(len(names))], pa.string())

    def _decoded(self, lists):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.codec.m.has_decoder:
            return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.names.take(lists.values)), " ")
        out = []
        for ids in lists.to_pylist():
            d = self.codec.decoder()
            out.append("".join(map(d.feed, ids)) + d.finish())
        return pa.array(out, pa.string())

    def __call__(self, column) -> tuple[list[int], list[str], list[str]]:
        import pyarrow as pa
        import pyarrow.compute as pc

        n = np.zeros(len(column), np.int64)
        ids, out = ([hashlib.sha256() for _ in range(len(column))] for _ in "ab")
        for rows, texts in pieces(column, self.piece):
            if long_run(texts):
                self._stream(texts[0].as_py(), rows[0], n, ids[rows[0]], out[rows[0]])
                continue
            runs = Runs(texts)
            starts, counts, flat = self.codec.encode_runs(runs.distinct)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat[ragged(starts, counts)]))
            full = counts[runs.codes] > 0  # runs without a token leave no space behind
            at = np.concatenate([[0], np.cumsum(full)])[runs.offsets]
            codes, at = pa.array(runs.codes[full]), pa.array(at, pa.int32())
            numbers = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.numbers.take(lists.values)), " ")
            for made, sep, hashes in ((numbers, " ", ids), (self._decoded(lists), self.join, out)):
                joined = pc.binary_join(pa.ListArray.from_arrays(at, made.take(codes)), sep)
                for row, text in zip(rows, joined):
                    text = text.as_buffer()
                    if text.size:
                        hashes[row].update(sep.encode() if n[row] else b"")
                        hashes[row].update(text)
            np.add.at(n, rows, runs.counted(counts))
        return n.tolist(), [h.hexdigest() for h in ids], [h.hexdigest() for h in out]

    def _stream(self, run: str, row: int, n: np.ndarray, ids, out) -> None:
        d = self.codec.decoder()
        for k in self.codec.stream_run(run):
            text = d.feed(k)
            ids.update(f" {k}".encode() if n[row] else b"%d" % k)
            out.update((self.join + text if n[row] and d.joined and not text.startswith(" ") else text).encode())
            n[row] += 1
        out.update(d.finish().encode())


def digest_texts(df, tokenizer_path: str, piece: int = PIECE):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text. The tokenizer file travels with the task.

    piece: bytes of text that a worker looks at together; more of them share more words and take more memory.
    """
    import pyarrow as pa

    short_batches(df.sparkSession)
    spec = shipped(df.sparkSession, tokenizer_path)

    def run(batches):
        digest = Digester(spec.value.codec(), piece)
        for batch in larger(batches, piece):
            n, ids, texts = digest(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df.doc_id.cast("long").alias("doc_id"), df.text.cast("string").alias("text")).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class Shipped:
    """A tokenizer file and character classes for the workers; a few MB whatever the table's size.

    A worker keeps the values of broadcasts between its tasks, and with this one the codec that it made of it.
    """

    def __init__(self, text: str, classes: dict[str, str]):
        self.text, self.classes, self.made = text, classes, None

    def codec(self) -> Codec:
        if self.made is None:
            self.made = Codec(Merges(json.loads(self.text)), self.classes)
            trim_memory()
        return self.made


def shipped(spark, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Shipped(f.read(), character_classes()))
