"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

The patterns (email, ip, card, phone) always stand. The field reads the words of a text (runs without the
bytes 0x20, 0x09-0x0D) by features of their shape and of their neighbours' shapes, is trained on a small
labelled table (``labelled_table``; another can be given) and decoded by Viterbi in numpy batches. Its spans
(the four kinds in other spellings, and ``secret``) count where they do not touch a pattern's span.

Only stretches of words that can hold a label other than O are decoded: a bound on the gain of every
stretch over all-O shows for all others that Viterbi would give O, so this changes no result.

Defined results: null and empty texts have no span; bytes that are no UTF-8 count as U+FFFD; spans are in code points, end exclusive; repeated rows are
treated row by row; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Interner, blocks, bounded_batches, drop_kept, id_and_text, pieces, readable, trimmed

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES, SENTENCES, EPOCHS, RIDGE = 2048, 600, 70, 1e-3
CACHE_WORDS, BATCH = 200_000, 256
#: Text bytes that ``redact`` looks at together: the arrays over their words take about a hundred times as much.
REDACT_BYTES = 1 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns, by kind, then start."""
    if not HINT.search(text):
        return []
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # every match holds one @, and begins at the first character of the run before it
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append((0, m.start(), m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape(word: str) -> str:
    """Letters as a, digits as 9, runs of one character as one; of long shapes a part and a hash of the whole."""
    out = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", word)), flags=re.DOTALL)
    return out if len(out) <= 24 else f"{out[:24]} {zlib.crc32(out.encode('utf-8', 'replace'))}"


def bucket(n: int) -> int:
    return n if n < 5 else 5 + (n > 8) + (n > 12) + (n > 19)


#: Words that announce personal data or stand inside spelled-out forms.
CUES = ("at", "(at)", "[at]", "dot", "(dot)", "[dot]", "token", "key", "secret", "password", "api_key", "=", ":", "call", "phone", "tel", "card", "mail", "email", "ip")


#: Fixed value: marks around a word that its features leave out.
MARKS = ".,;:!?#$%&*\"'|<>"


def neighbour(word: str) -> str:
    """What a word tells about the words beside it."""
    low = word.lower().strip(".,;!\"'")
    if low in CUES or word in CUES:
        return f"cue {low or word}"
    digits = sum(c in "0123456789" for c in word)
    if not digits:
        return "@" if "@" in word else "word"
    return f"{bucket(digits)} {word[0] in '+('} {'.' in word.strip('.')} {any(c.isalpha() for c in word)}"


def features(word: str) -> list[str]:
    core = word.strip(MARKS)
    digits = sum(c in "0123456789" for c in core)
    letters = sum(c.isalpha() for c in core)
    out = ["bias", f"s {shape(core)}", f"d {bucket(digits)} {bucket(letters)}", f"n {neighbour(word)}"]
    if digits and not letters:
        out.append(f"only {bucket(digits)} {'.' in core} {'-' in core} {core[:1] in '+('}")
    if len(core) >= 16 and digits >= 4 and all(c in "0123456789abcdefABCDEF" for c in core):
        out.append("hex")
    if "@" in core:
        out.append(f"at {'.' in core.partition('@')[2]}")
    return out


@functools.lru_cache(maxsize=4096)
def code(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


def word_codes(word: str) -> tuple[list[int], int, int]:
    """Codes of a word's own features, and those it gives to the next and to the previous word."""
    side = neighbour(word)
    return [code(f) for f in features(word)], code(f"prev {side}"), code(f"next {side}")


def labelled_table(n: int = SENTENCES, seed: int = 7) -> list[list[tuple[str, str]]]:
    """A small table of labelled sentences: invented words with personal data in many spellings, and with
    numbers that are none."""
    r = random.Random(seed)
    parts = ["an", "er", "tion", "sch", "eau", "ado", "ing", "que", "the", "lich", "oi", "mente", "re", "st"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    tail = lambda: r.choice([""] * 6 + [",", ".", "!!", "###", "***", "$$$", "%%%", "&&&"])

    def span(kind: str, words: list[str]) -> list[tuple[str, str]]:
        words = [*words[:-1], words[-1] + tail()]
        return [(w, f"{'I' if k else 'B'}-{kind}") for k, w in enumerate(words)]

    forms = (
        lambda: span("email", [f"{word()}.{digits(2)}@{word()}{r.randint(0, 9)}.example.com"]),
        lambda: span("email", [f"{word()}@{word()}.org"]),
        lambda: span("email", [word(), r.choice(["at", "(at)", "[at]"]), word(), r.choice(["dot", "(dot)", "[dot]"]), r.choice(["com", "org", "net"])]),
        lambda: span("email", [word() + digits(2), "(at)", f"{word()}.com"]),
        lambda: span("phone", ["+1", f"({digits(3)})", f"555-{digits(4)}"]),
        lambda: span("phone", [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]),
        lambda: span("phone", [f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        lambda: span("phone", [f"+{digits(2)}", digits(2), digits(4), digits(4)]),
        lambda: span("phone", [f"+{digits(11)}"]),
        lambda: span("ip", [".".join(str(r.randint(0, 255)) for _ in range(4))]),
        lambda: span("card", [digits(16)]),
        lambda: span("card", [digits(4) for _ in range(4)]),
        lambda: span("card", ["-".join(digits(4) for _ in range(4))]),
        lambda: [(r.choice(["token", "key", "secret", "api_key"]), "O"), (r.choice(["=", ":"]), "O"), *span("secret", [f'"{hexes(r.choice([32, 40]))}"'])],
        lambda: span("secret", [hexes(40)]),
        lambda: [(f"{r.choice(['Version', 'version', 'BY-NC'])}", "O"), (f"{r.randint(1, 9)}.{r.randint(0, 9)}.", "O")],
        lambda: [(r.choice(["version", "page"]), "O"), (f"{r.randint(1, 99)}.", "O")],
        lambda: [(str(r.randint(1900, 2030)) + tail(), "O")],
        lambda: [(f"{r.choice('$€')}{digits(2)}.{digits(2)}", "O")],
        lambda: [(digits(r.randint(1, 8)) + tail(), "O")],
        lambda: [(f"{digits(2)}:{digits(2)}", "O")],
        lambda: [(f"{digits(4)}-{digits(2)}-{digits(2)}", "O")],
        lambda: [(r.choice(["at", "dot", "token", "key", "call", "card", "mail"]) + tail(), "O")],
        lambda: [(r.choice(["at", "At", "dot"]) + tail(), "O") for _ in range(r.randint(1, 5))],
        lambda: [(word(), "O"), (r.choice(["at", "dot"]), "O"), (word() + tail(), "O")],
        lambda: [(word(), "O"), ("at", "O"), (word(), "O"), ("at", "O"), (word() + tail(), "O")],
        lambda: [(r.choice(["|", "#", "@", "&", "=", ":", "-", "@@", "a@", "+", "(at)"]), "O")],
    )
    table = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(0, 3)):
            row += [(r.choice([str.lower, str.lower, str.capitalize, str.upper])(word()) + tail(), "O") for _ in range(r.randint(1, 6))]
            row += r.choice(forms)()
        row += [(word() + tail(), "O") for _ in range(r.randint(1, 5))]
        table.append(row)
    return table


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Crf:
    """Weights of features (a row a feature, a column a label) and of transitions."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def train(cls, table: list[list[tuple[str, str]]]) -> Crf:
        """Penalised maximum likelihood by Adam over padded batches (forward and backward sums)."""
        n_labels = len(LABELS)
        rows = [r for r in table if r]
        width = max(map(len, rows))
        x = np.zeros((len(rows), width, FEATURES), np.float32)
        y = np.zeros((len(rows), width), np.int64)
        mask = np.zeros((len(rows), width), bool)
        for i, row in enumerate(rows):
            codes = [word_codes(w) for w, _ in row]
            for t, (own, _, _) in enumerate(codes):
                for f in own:
                    x[i, t, f] = 1
                if t:
                    x[i, t, codes[t - 1][1]] = 1
                if t + 1 < len(codes):
                    x[i, t, codes[t + 1][2]] = 1
                y[i, t], mask[i, t] = LABELS.index(row[t][1]), True
        used = np.flatnonzero(x.any((0, 1)))
        x = x[:, :, used]
        emit, move = np.zeros((len(used), n_labels)), np.zeros((n_labels, n_labels))
        moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
        gold = np.zeros((len(rows), width, n_labels))
        gold[np.arange(len(rows))[:, None], np.arange(width), y] = mask
        pairs = mask[:, 1:]
        gold_move = np.zeros_like(move)
        np.add.at(gold_move, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        for step in range(1, EPOCHS + 1):
            e = x @ emit.astype(np.float32)
            fwd, bwd = np.zeros_like(e, np.float64), np.zeros_like(e, np.float64)
            fwd[:, 0] = e[:, 0]
            for t in range(1, width):
                fwd[:, t] = np.where(mask[:, t, None], logsumexp(fwd[:, t - 1, :, None] + move, 1) + e[:, t], fwd[:, t - 1])
            for t in range(width - 2, -1, -1):
                bwd[:, t] = np.where(mask[:, t + 1, None], logsumexp(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
            z = logsumexp(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
            g_emit = np.einsum("itf,itl->fl", x, (p - gold).astype(np.float32), optimize=True) / len(rows) + RIDGE * emit
            g_move = -gold_move
            for t in range(1, width):
                joint = fwd[:, t - 1, :, None] + move + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]
                g_move = g_move + (np.exp(joint) * mask[:, t, None, None]).sum(0)
            g_move = g_move / len(rows) + RIDGE * move
            for k, (w, g) in enumerate(((emit, g_emit), (move, g_move))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        whole = np.zeros((FEATURES, n_labels))
        whole[used] = emit
        return cls(whole, move)

    def viterbi(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence of emission rows; sequences of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda k: len(emissions[k]))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            width = len(emissions[some[-1]])
            if not width:
                continue
            lens = np.array([len(emissions[k]) for k in some])
            e = np.zeros((len(some), width, len(LABELS)))
            for i, k in enumerate(some):
                e[i, : lens[i]] = emissions[k]
            best, back = e[:, 0], np.zeros((len(some), width, len(LABELS)), np.int8)
            for t in range(1, width):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                best = np.where((t < lens)[:, None], step.max(1) + e[:, t], best)
            label = best.argmax(1)
            path = np.zeros((len(some), width), np.int64)
            for t in range(width - 1, -1, -1):
                here = t < lens
                path[here, t] = label[here]
                inner = here & (t > 0)
                label[inner] = back[inner, t, label[inner]]
            for i, k in enumerate(some):
                out[k] = path[i, : lens[i]]
        return out


@functools.lru_cache(maxsize=1)
def default_crf() -> Crf:
    return Crf.train(labelled_table())


class Finder:
    """Finds spans in blocks of texts; each distinct word is looked at once."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.lift = float(max(0.0, (crf.move - crf.move[0, 0]).max()))
        self.clear()

    def clear(self) -> None:
        self.words = Interner()
        self.own = np.zeros((0, len(LABELS)))
        self.gain, self.sides = np.zeros(0), np.zeros((0, 2), np.int64)

    def learn(self) -> None:
        fresh = list(self.words)[len(self.gain) :]
        if not fresh:
            return
        own, sides = np.zeros((len(fresh), len(LABELS))), np.zeros((len(fresh), 2), np.int64)
        like: dict[int, int] = {}
        source = np.arange(len(fresh))
        for k, word in enumerate(fresh):
            core = word.strip(MARKS)
            if core.isalpha() and core.lower() not in CUES:
                # such words differ in nothing but how many letters they have
                source[k] = like.setdefault(bucket(len(core)), k)
                if source[k] != k:
                    continue
            codes, after, before = word_codes(word)
            own[k], sides[k] = self.crf.emit[sorted(set(codes))].sum(0), (after, before)
        own, sides = own[source], sides[source]
        gap = lambda e: (e[:, 1:] - e[:, :1]).max(1)
        self.own = np.concatenate((self.own, own))
        self.sides = np.concatenate((self.sides, sides))
        self.gain = np.concatenate((self.gain, gap(own)))

    def find(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text the field's spans (kind number, start, end)."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        parts = pc.ascii_split_whitespace(texts)
        off = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        off -= off[0]
        names = coded.dictionary.to_pylist()
        word = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))[np.asarray(coded.indices)] if len(names) else np.zeros(0, np.int64)
        self.learn()
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        if (blank := self.words.get("")) is not None and (word == blank).any():
            keep = word != blank
            off = np.concatenate(([0], np.cumsum(keep)))[off]
            word = word[keep]
        if not len(word):
            return out
        side_gap = (self.crf.emit[:, 1:] - self.crf.emit[:, :1]).max(1)
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        first, last = np.zeros(len(word), bool), np.zeros(len(word), bool)
        full = np.diff(off) > 0
        first[off[:-1][full]], last[off[1:][full] - 1] = True, True
        prev_code = np.where(first, -1, np.roll(self.sides[word, 0], 1))
        next_code = np.where(last, -1, np.roll(self.sides[word, 1], -1))
        bound = self.gain[word] + np.where(prev_code >= 0, side_gap[prev_code], 0) + np.where(next_code >= 0, side_gap[next_code], 0) + self.lift
        # leaving a stretch costs one more transition: counted at its first word
        total = np.cumsum(bound) - 1e6 * doc  # stretches do not cross texts
        before = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])) - 1e6 * np.diff(doc, prepend=0))
        before = np.minimum.accumulate(np.where(first, np.concatenate(([0.0], total[:-1])) - 1e6 * np.diff(doc, prepend=0), np.concatenate(([0.0], total[:-1]))))
        after = np.maximum.accumulate(total[::-1])[::-1]
        can = after - before + self.lift > 0
        if not can.any():
            return out
        # one O on each side of a stretch, so that it begins and ends as in the whole text
        wide = can.copy()
        wide[:-1] |= can[1:] & (doc[1:] == doc[:-1])
        wide[1:] |= can[:-1] & (doc[1:] == doc[:-1])
        edge = np.flatnonzero(wide)
        cuts = np.flatnonzero((np.diff(edge) > 1) | (doc[edge[1:]] != doc[edge[:-1]])) + 1
        runs = np.split(edge, cuts)
        e = self.own[word[edge]].copy()
        for codes in (prev_code[edge], next_code[edge]):
            e[codes >= 0] += self.crf.emit[codes[codes >= 0]]
        paths = self.crf.viterbi(np.split(e, cuts))
        places: dict[int, list[tuple[int, int]]] = {}
        for run, path in zip(runs, paths, strict=True):
            if not path.any():
                continue
            d = int(doc[run[0]])
            text = texts[d].as_py()
            if d not in places:
                places = {d: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]}
            k = 0
            while k < len(path):
                if not path[k]:
                    k += 1
                    continue
                kind, stop = (path[k] - 1) // 2, k + 1
                while stop < len(path) and path[stop] == 2 + 2 * kind:
                    stop += 1
                start, end = places[d][run[k] - off[d]][0], places[d][run[stop - 1] - off[d]][1]
                while start < end and not text[start].isalnum() and text[start] not in "+(":
                    start += 1
                while end > start and not text[end - 1].isalnum():
                    end -= 1
                if start < end:
                    out[d].append((int(kind), start, end))
                k = stop
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def merge_spans(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of ``more`` that do not touch one, by kind, then start."""
    return sorted(base + [s for s in more if all(s[2] <= a or b <= s[1] for _, a, b in base)])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone long: base spans; base string, spans string) of every whole text:
    ``kind:start:end`` by kind, then start, joined by commas. One narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(crf or default_crf())  # FEATURES rows

    def run(batches):
        finder = Finder(shared.value)
        for table in blocks(batches, 4 << 20):
            texts = readable(table.column("text").combine_chunks())
            base = [base_spans(t) for t in texts.to_pylist()]
            every = [merge_spans(b, m) for b, m in zip(base, finder.find(texts), strict=True)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(4)]
            yield from pa.table([table.column("id").combine_chunks(), *counts, pa.array(map(joined, base), pa.string()), pa.array(map(joined, every), pa.string())], ["id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]).to_batches()

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[kind]``, other columns as they were. Spans that
    overlap are replaced together under the name of the first."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(crf or default_crf())

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        drop_kept()
        finder, at = Finder(shared.value), names.index(text_col)
        for batch in batches:
            for part in pieces(batch, text_col, REDACT_BYTES):
                texts = readable(part.column(at)).to_pylist()
                some = pa.array([t or "" for t in texts], pa.string())
                new = [t if t is None else clean(t, merge_spans(base_spans(t), m)) for t, m in zip(texts, finder.find(some), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)


def sha256_of(column: str) -> F.Column:
    return F.sha2(F.col(column), 256)
