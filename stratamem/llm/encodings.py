"""Text decoded with the wrong character encoding, as a substitution cipher.

A swap of code pages turns every letter beyond ASCII into a symbol of one or more
characters. Which swap a source suffered is unknown, so each source gets its own
table from symbols to letters, learned by expectation-maximisation against the
language's bigrams (:func:`ciphers`): the E-step tells for every symbol between two
known characters which letter may stand there, or whether it stands for itself; the
M-step re-estimates the table and how often the source is garbled at all. The table
is applied by ``str.translate``, and by pattern where a symbol has several characters.

Sources suffer several swaps, and rare symbols tell little by themselves. Known pairs
of code pages therefore seed further tables, which a second round of EM weighs by
source and by document together with the learned one; a token is changed only where
the letters win by ``NATS`` over what stands there.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import filterfalse
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.storage import materialize, width

#: Readings of UTF-8 under another code page, and swaps ``(true, read as)`` of two others.
UTF8_READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r", "cp866", "gbk")
SWAPS = (
    ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1250", "cp1251"), ("cp1254", "cp1251"), ("cp1254", "cp1252"), ("cp1251", "cp1252"),
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1251", "cp866"), ("cp1252", "cp437"),
    ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("gbk", "cp1252"), ("iso8859-2", "cp1252"),
)
NAMES = ("none", *(f"utf-8 read as {w}" for w in UTF8_READ_AS), *(f"{t} read as {w}" for t, w in SWAPS), "learned")
#: The kind that applies the table learned for the source.
LEARNED = len(NAMES) - 1
#: A run of so many characters beyond ASCII is one symbol; symbols seen less often in a source are not deciphered.
SYMBOL = re.compile("(?<![^\x00-\x7f])[^\x00-\x7f]{1,3}(?![^\x00-\x7f])")
SEEN = 5
#: Letters a symbol may stand for: the most frequent single characters of those seen so often; symbols whose use by all sources is told apart.
LETTERS, LETTER_SEEN, SYMBOLS = 256, 10, 1024
#: Rounds of EM over the tables. Share of garbled symbols at first, symbols a letter is spread over at first.
TABLE_ROUNDS, GARBLED, SPREAD = 12, 0.02, 128
#: Weight of the general contexts in those of one symbol; how often one that no other source has is taken to stand for itself.
SMOOTH, ALONE = 5.0, 0.5
#: A letter that other sources use stands for itself unless a source has so many times their share.
FOREIGN = 20
#: A symbol has a letter if so much of what it does not stand for itself is that letter's.
CLEAR = 0.6
#: Prior of a swap before anything is learned, weight of the prior in tokens, nats by which a swap must win.
PRIOR, PRIOR_TOKENS, NATS = 1e-3, 20.0, 3.0
#: Rounds over the vocabulary, and within a document whose tokens share their swaps; what the source's rates weigh there in tokens.
ROUNDS, DOCUMENT_ROUNDS, DOCUMENT_PRIOR = 3, 6, 3.0
#: Scores kept by a worker process, by run.
SCORED: dict[str, tuple] = {}
ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
LOST = "�"
#: What ``str.translate`` leaves as it is; to find a character is quicker than to miss it.
ASCII = {i: i for i in range(128)}


@cache
def characters(codec: str) -> dict[str, int]:
    """Byte of each character beyond ASCII; bytes a page leaves open stand for themselves."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if codec.startswith(("cp125", "iso")) else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@cache
def inverse(kind: int) -> Callable[[str], str]:
    """Undo swap ``kind`` once in a token, leaving what it cannot have made."""
    if kind <= len(UTF8_READ_AS):
        read_as = UTF8_READ_AS[kind - 1]
        if read_as == "gbk":
            run = re.compile("[^\x00-ÿ–-”…]+[\x00-\x7f]?")

            def undo(match: re.Match) -> str:
                text = match.group()
                try:
                    raw = text.replace(LOST, "").encode("gbk")
                except UnicodeEncodeError:
                    return text
                out = raw.decode("utf-8", "replace")
                return out if out.count(LOST) <= 1 + text.count(LOST) and len(out) < 0.8 * len(raw) else text

            return lambda t: run.sub(undo, t)
        byte = characters(read_as)
        of = lambda low, high: "[" + "".join(re.escape(c) for c, b in byte.items() if low <= b <= high) + "]"
        more = of(0x80, 0xBF)
        symbol = re.compile(f"{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}}")

        def letter(match: re.Match) -> str:
            try:
                return bytes(byte[c] for c in match.group()).decode("utf-8")
            except UnicodeDecodeError:
                return match.group()

        return lambda t: symbol.sub(letter, t)
    true, read_as = SWAPS[kind - 1 - len(UTF8_READ_AS)]
    byte = characters(read_as)
    if true == "gbk":
        pair = re.compile("[" + "".join(re.escape(c) for c, b in byte.items() if 0xA1 <= b <= 0xF7) + "][" + "".join(re.escape(c) for c, b in byte.items() if b >= 0xA1) + "]")

        def two(match: re.Match) -> str:
            try:
                return bytes(byte[c] for c in match.group()).decode("gbk")
            except UnicodeDecodeError:
                return match.group()

        return lambda t: pair.sub(two, t)
    table = dict(ASCII)
    for c, b in byte.items():
        try:
            table[ord(c)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
    return lambda t: t.translate(table)


def restored(token: str, kind: int) -> str:
    """Undo a swap as often as it was made."""
    undo = inverse(kind)
    out = undo(token)
    if kind > len(UTF8_READ_AS) or out == token:
        return out
    seen = {token}
    while out not in seen:
        seen.add(out)
        out = undo(out)
    return out


def unescaped(token: str) -> str:
    """Entities, percent and backslash escapes resolved, as often as they were made: every one is longer than what it stands for."""
    while True:
        out = html.unescape(token) if "&" in token else token
        if "\\" in out:
            out = ESCAPED.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)), out)
        if "%" in out:
            try:
                out = unquote(out, errors="strict")
            except UnicodeDecodeError:
                pass
        if out == token:
            break
        token = out
    return token


def tokens(text: str) -> Iterator[str]:
    """Tokens with a character beyond ASCII, once escapes are resolved. Only ASCII blanks part tokens: others may be part of a symbol."""
    parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    if "&" in text or "\\" in text or "%" in text:
        parts = [unescaped(t) if "&" in t or "\\" in t or "%" in t else t for t in parts]
    return filterfalse(str.isascii, parts)


class Pairs(dict):
    """A number for each pair of characters, reckoned when first asked for."""

    def __init__(self, reckon: Callable[[tuple[str, str]], float]):
        super().__init__()
        self.reckon = reckon

    def __missing__(self, pair: tuple[str, str]) -> float:
        out = self[pair] = self.reckon(pair)
        return out


class Language:
    """Bigrams of folded characters, smoothed by single ones; a change of case inside a word costs extra."""

    def __init__(self, bigrams: dict[tuple[str, str], float]):
        self.first: Counter = Counter()
        self.single: Counter = Counter()
        for (a, b), n in bigrams.items():
            self.first[a] += n
            self.single[b] += n
        self.total = sum(self.single.values()) + 1e6
        self.bigrams = bigrams
        self.known = Pairs(self.step)
        self.rises = Pairs(lambda pair: pair[0].islower() and pair[1].isupper())

    def step(self, pair: tuple[str, str]) -> float:
        a, b = pair
        back = (self.single.get(b, 0.0) + 0.02) / self.total
        return math.log((self.bigrams.get(pair, 0.0) + 2 * back) / (self.first.get(a, 0.0) + 2))

    def score(self, token: str) -> float:
        folded = token.lower()
        out = sum(map(self.known.__getitem__, zip("\x02" + folded, folded + "\x03", strict=True)))
        if folded != token and not token[1:].islower() and not token.isupper():
            out -= 3.0 * sum(map(self.rises.__getitem__, zip(token, token[1:], strict=False)))
        return out


PAIR = re.compile("[^\x00-\x7f]{2}")
BEYOND = re.compile("[^\x00-\x7f]")


@cache
def kinds_of(character: str) -> int:
    """Bit mask of the swaps that may have made a character."""
    mask = 0
    for i, codec in enumerate(UTF8_READ_AS):
        if codec == "gbk" or character in characters(codec):
            mask |= 1 << (i + 1)
    for i, (true, codec) in enumerate(SWAPS):
        if character in characters(codec) and (true == "gbk" or inverse(i + 1 + len(UTF8_READ_AS))(character) != character):
            mask |= 1 << (i + 1 + len(UTF8_READ_AS))
    return mask


@lru_cache(4096)
def kinds_among(mask: int, paired: bool) -> tuple[int, ...]:
    """The swaps of a mask; those that make two characters of one only if there are two in a row."""
    return tuple(k for k in range(1, LEARNED) if mask >> k & 1 and (paired or k >= len(UTF8_READ_AS)))


@cache
def one_by_one(character: str) -> tuple[tuple[int, str | None], ...]:
    """What each swap that may have made a character puts in its place where no other stands beside it; None for that by GBK, which may take the next character along."""
    return tuple((k, None if k == len(UTF8_READ_AS) else restored(character, k)) for k in kinds_among(kinds_of(character), False))


def candidates(token: str) -> list[tuple[int, str]]:
    """The token as it is, and as each swap that changes it would have found it."""
    out = [(0, token)]
    beyond = set(BEYOND.findall(token))
    paired = PAIR.search(token) is not None
    if len(beyond) == 1 and not paired:  # many: what the one letter becomes is known without the token
        (c,) = beyond
        for kind, letter in one_by_one(c):
            letters = restored(token, kind) if letter is None else token.replace(c, letter)
            if letters != token:
                out.append((kind, letters))
        return out
    mask = 0
    for c in beyond:
        mask |= kinds_of(c)
    for kind in kinds_among(mask, paired):
        letters = restored(token, kind)
        if letters != token:
            out.append((kind, letters))
    return out


def scored(token: str, model: Language) -> list[tuple[int, str, float]]:
    """The candidates with their scores; those with a character that the language does not know are left out. A token that has no others is not scored."""
    scores: dict[str, float] = {}
    out = []
    every = candidates(token)
    if len(every) == 1:
        return [(0, token, 0.0)]
    for kind, letters in every:
        if letters not in scores:
            if kind and not model.single.keys() >= set(letters.lower()):
                continue
            scores[letters] = model.score(letters)
        out.append((kind, letters, scores[letters]))
    return out


class Cipher:
    """The table of a source, applied to tokens."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.single = ASCII | str.maketrans({k: v for k, v in table.items() if len(k) == 1})
        several = sorted((k for k in table if len(k) > 1), key=lambda k: (-len(k), k))
        self.several = re.compile("|".join(map(re.escape, several))) if several else None

    def __call__(self, token: str) -> str:
        if self.several is not None:
            token = self.several.sub(lambda m: self.table[m.group()], token)
        return token.translate(self.single)


def with_learned(options: list[tuple[int, str, float]], token: str, cipher: Cipher | None, model: Language) -> list[tuple[int, str, float]]:
    """The options of a token with that of its source's own table, if no other gives the same letters."""
    letters = cipher(token) if cipher is not None else token
    if any(letters == t for _, t, _ in options):
        return options
    if len(options) == 1:
        options = [(0, token, model.score(token))]
    return [*options, (LEARNED, letters, model.score(letters))]


def symbol_contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(source, symbol, before, after, n)`` of every symbol next to an ASCII letter."""
    for f in frames:
        use: Counter = Counter()
        for source, token, n in zip(f.source, f.token, f.n, strict=True):
            if LOST in token:
                continue
            for m in SYMBOL.finditer(token):
                if unicodedata.category(m.group()[0]) in ("Ps", "Pi"):
                    continue  # a quotation mark and what it opens
                before, after = token[m.start() - 1] if m.start() else "\x02", token[m.end()] if m.end() < len(token) else "\x03"
                if before.isalpha() or after.isalpha():
                    use[source, m.group(), before, after] += n
        yield pd.DataFrame([(*k, v) for k, v in use.items()], columns=["source", "symbol", "before", "after", "n"])


class Contexts:
    """How often each symbol stands after and before each ASCII character, over all sources."""

    def __init__(self, symbols: list[tuple[str, float]], sides: dict[tuple[str, str, str], float], total: float):
        self.names = [c for c, _ in symbols]
        self.row = {c: i for i, c in enumerate(self.names)}
        self.count, self.total = np.array([n for _, n in symbols], dtype=float), total
        self.place = {chr(i): i for i in range(128)}
        self.letters = np.array([i for i, c in enumerate(self.names) if len(c) == 1][:LETTERS], dtype=int)
        self.beside = {side: np.zeros((len(symbols), 128)) for side in ("before", "after")}
        for (side, c, x), v in sides.items():
            self.beside[side][self.row[c], self.place[x]] = v
        self.general = {side: (n.sum(axis=0) + 0.01) / (n.sum() + 1.28) for side, n in self.beside.items()}

    def logs(self, side: str, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTH * self.general[side]) / (counts.sum(axis=1, keepdims=True) + SMOOTH))


def decipher(rows: pd.DataFrame, language: Contexts) -> list[tuple[str, str, float, float]]:
    """``(symbol, letter, tokens, share)`` of one source: EM over a substitution cipher with a share of garbled symbols.

    What a symbol looks like where it stands for itself is what the *other* sources
    make of it; what they do not know and a letter's contexts explain is garbled. A
    source with no others to compare with has nothing to learn from.
    """
    rows = rows[(rows.groupby("symbol").n.transform("sum") >= SEEN)]
    n = rows.n.to_numpy(dtype=float)
    elsewhere = language.total - n.sum()
    if not len(rows) or not len(language.letters) or elsewhere < n.sum() / 20:
        return []
    names, at = np.unique(rows.symbol.to_numpy(dtype=object), return_inverse=True)
    sides = {c: rows[c].map(language.place).to_numpy() for c in ("before", "after")}
    known = np.array([language.row.get(s, -1) for s in names])
    here, letter, alone = np.bincount(at, n, len(names)), np.zeros((len(language.letters), len(rows))), np.zeros(len(rows))
    for side, place in sides.items():
        own = np.zeros((len(names), 128))
        np.add.at(own, (at, place), n)
        others = np.where(known[:, None] >= 0, language.beside[side][known] - own, 0.0).clip(0)
        alone += language.logs(side, others)[at, place]
        letter += language.logs(side, language.beside[side][language.letters])[:, place]
    mass = np.where(known >= 0, language.count[known] - here, 0.0).clip(0) * (n.sum() / elsewhere) + ALONE
    letter_mass = language.count[language.letters] / language.total * n.sum()
    itself = known[:, None] == language.letters[None, :]
    table, share = np.full((len(names), len(language.letters)), 1.0 / SPREAD), GARBLED
    expected = np.zeros_like(table)
    for _ in range(TABLE_ROUNDS):
        with np.errstate(divide="ignore"):
            weight, stay = np.log(letter_mass * share * np.where(itself, 0.0, table)), np.log(mass * (1 - share))
        expected[:] = 0
        for i in range(0, len(rows), 4096):
            s = slice(i, i + 4096)
            logs, stays = letter[:, s].T + weight[at[s]], alone[s] + stay[at[s]]
            most = np.maximum(logs.max(axis=1), stays)
            odds = np.exp(logs - most[:, None])
            np.add.at(expected, at[s], odds / (odds.sum(axis=1) + np.exp(stays - most))[:, None] * n[s][:, None])
        table = (expected + 0.1 / SPREAD) / (expected.sum(axis=0) + 0.1)
        share = min(0.5, max(1e-4, expected.sum() / n.sum()))
    best = expected.argmax(axis=1)
    won = expected[np.arange(len(names)), best]
    letters = np.array([len(k) == 1 and k.isalpha() for k in names])
    foreign = ~letters | (mass <= LETTER_SEEN * n.sum() / elsewhere + ALONE) | (here >= FOREIGN * mass)
    good = foreign & (won >= SEEN / 2) & (won >= CLEAR * expected.sum(axis=1))
    found: dict[str, tuple[str, float]] = {}
    for k in sorted(np.flatnonzero(good), key=lambda k: (-won[k], names[k])):
        to = language.names[language.letters[best[k]]]
        if to not in found:  # what is garbled itself is no letter
            found[str(names[k])] = (to, round(float(won[k]), 3))
    seen = dict(zip(names.tolist(), here, strict=True))
    return [(k, *v, min(1.0, v[1] / seen[k])) for k, v in found.items() if len(k) == 1 or not all(c in found for c in k)]


def ciphers(vocabulary: DataFrame) -> DataFrame:
    """``(source, symbol, letter, tokens, share)``: the substitution table learned for each source, and which share of each symbol it explains.

    The driver gets how often the ``SYMBOLS`` most frequent symbols stand beside each
    ASCII character; a source's contexts are counts by symbol and two ASCII
    characters, so no more however many documents it has.
    """
    spark = vocabulary.sparkSession
    contexts = vocabulary.mapInPandas(symbol_contexts, "source string, symbol string, before string, after string, n double")
    contexts = materialize(contexts.groupBy("source", "symbol", "before", "after").agg(F.sum("n").alias("n")), "symbol-contexts")
    plain = contexts.where((F.octet_length("before") == 1) & (F.octet_length("after") == 1))
    counts = materialize(plain.groupBy("symbol").agg(F.sum("n").alias("n")), "symbol-counts")
    frequent = counts.where(F.col("n") >= LETTER_SEEN).orderBy(F.desc("n"), "symbol").limit(SYMBOLS)
    symbols = [(r.symbol, r.n) for r in frequent.collect()]
    ends = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("c")) for c in ("before", "after")])
    beside = plain.join(F.broadcast(frequent.select("symbol")), "symbol").select("symbol", "n", F.explode(ends).alias("x"))  # SYMBOLS rows at most
    sides = {(r.side, r.symbol, r.c): r.n for r in beside.groupBy("x.side", "symbol", "x.c").agg(F.sum("n").alias("n")).collect()}
    total = counts.agg(F.sum("n")).first()[0] or 0.0
    language = spark.sparkContext.broadcast(Contexts(symbols, sides, total))

    def learned(rows: pd.DataFrame) -> pd.DataFrame:
        found = decipher(rows, language.value)
        return pd.DataFrame([(rows.source.iloc[0], *r) for r in found], columns=["source", "symbol", "letter", "tokens", "share"])

    return materialize(plain.groupBy("source").applyInPandas(learned, "source string, symbol string, letter string, tokens double, share double"), "ciphers")


class Tables:
    """The table of each source, the share of each symbol it explains, and how many tokens it explains in all."""

    def __init__(self, learned: DataFrame):
        self.letter: dict[str, dict[str, str]] = defaultdict(dict)
        self.share: dict[str, dict[str, float]] = defaultdict(dict)
        self.tokens: dict[str, float] = defaultdict(float)
        for r in learned.collect():  # no more rows than symbols in use
            self.letter[r.source][r.symbol] = r.letter
            self.share[r.source][r.symbol] = r.share
            self.tokens[r.source] += r.tokens

    def ciphers(self) -> dict[str, Cipher]:
        return {s: Cipher(t) for s, t in self.letter.items()}


def logs_of(rates: dict[int, float]) -> list[float]:
    """Log rate of each swap, by its number; 0 of none."""
    return [0.0, *(math.log(rates.get(k, PRIOR)) for k in range(1, len(NAMES)))]


def odds_of(options: list[tuple[int, str, float]], logs: list[float]) -> list[float]:
    """Odds of each candidate of a token against the likeliest."""
    sums = [x + logs[k] for k, _, x in options]
    most = max(sums)
    return [math.exp(x - most) for x in sums]


def weighed(options: list[tuple[int, str, float]], logs: list[float]) -> list[tuple[int, str, float]]:
    """Posterior of each candidate of a token."""
    odds = odds_of(options, logs)
    total = sum(odds)
    return [(k, t, x / total) for (k, t, _), x in zip(options, odds, strict=True)]


def add_bigrams(to: dict[tuple[str, str], float], token: str, n: float) -> None:
    folded = token.lower()
    for pair in zip("\x02" + folded, folded + "\x03", strict=True):
        to[pair] = to.get(pair, 0.0) + n


def bigrams_of(rows: Iterator[tuple[str, float]]) -> dict[tuple[str, str], float]:
    out: dict[tuple[str, str], float] = {}
    for token, n in rows:
        add_bigrams(out, token, n)
    return out


def token_counts(read: DataFrame) -> DataFrame:
    """``(source, token, n)``, equal tokens side by side; counted within batches before anything is shuffled."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            use: dict[str, Counter] = defaultdict(Counter)
            for source, text in zip(f.source, f.text, strict=True):
                use[source].update(tokens(text))
            yield pd.DataFrame([(s, t, float(n)) for s, c in use.items() for t, n in c.items()], columns=["source", "token", "n"])

    sums = read.select("source", "text").mapInPandas(counted, "source string, token string, n double").groupBy("source", "token").agg(F.sum("n").alias("n"))
    parts = width(read.sparkSession, 0, 1)
    return materialize(sums.repartition(parts, "token").sortWithinPartitions("token"), "tokens")


def learn(vocabulary: DataFrame, tables: Tables) -> tuple[dict, dict[str, dict[int, float]]]:
    """Bigrams of the language, and the rate of each swap by source."""
    spark = vocabulary.sparkSession
    own = spark.sparkContext.broadcast(tables)

    def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cipher, shares = own.value.ciphers(), own.value.share
        for f in frames:
            raw, moved = bigrams_of(zip(f.token, f.n, strict=True)), {}
            for source, token, n in zip(f.source, f.token, f.n, strict=True):
                letters = cipher[source](token) if source in cipher else token
                if letters != token:
                    sure = min((v for k, v in shares[source].items() if k in token), default=0.0)
                    for text, weight in ((letters, n * sure), (token, -n * sure)):
                        add_bigrams(moved, text, weight)
            yield pd.DataFrame([(w, a, b, float(n)) for w, c in (("raw", raw), ("moved", moved)) for (a, b), n in c.items()], columns=["what", "a", "b", "n"])

    counted = materialize(vocabulary.mapInPandas(plain, "what string, a string, b string, n double").groupBy("what", "a", "b").agg(F.sum("n").alias("n")), "bigrams")
    raw = {(r.a, r.b): r.n for r in counted.where("what = 'raw'").collect()}
    moved = {(r.a, r.b): r.n for r in counted.where("what = 'moved'").collect()}
    # what the tables explain is no use of its symbols
    bigrams = {k: max(0.0, raw.get(k, 0.0) + moved.get(k, 0.0)) for k in raw.keys() | moved.keys()}

    total = {r.source: r.n for r in vocabulary.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    rates = {s: {LEARNED: min(0.5, n / total[s])} for s, n in tables.tokens.items()}
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((bigrams, rates))

        def expect(frames: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            grams, by_source = state.value
            model, logs, unknown = Language(grams), {s: logs_of(r) for s, r in by_source.items()}, logs_of({})
            last, base = None, []
            cipher = own.value.ciphers()
            for f in frames:
                change: dict[tuple[str, str], float] = {}
                use: Counter = Counter()
                for source, token, n in zip(f.source, f.token, f.n, strict=True):
                    if LOST in token:
                        continue
                    if token != last:
                        last, base = token, scored(token, model)
                    options = with_learned(base, token, cipher.get(source), model)
                    for kind, letters, p in weighed(options, logs.get(source, unknown)) if len(options) > 1 else []:
                        if p > 1e-6:
                            use[source, kind] += p * n
                            if kind:
                                for text, weight in ((letters, n * p), (token, -n * p)):
                                    add_bigrams(change, text, weight)
                rows = [("bigram", a, b, 0, n) for (a, b), n in change.items() if n] + [("use", s, "", k, n) for (s, k), n in use.items()]
                yield pd.DataFrame(rows, columns=["what", "a", "b", "kind", "n"])

        seen = materialize(vocabulary.mapInPandas(expect, "what string, a string, b string, kind int, n double").groupBy("what", "a", "b", "kind").agg(F.sum("n").alias("n")), "expected")
        moved = {(r.a, r.b): r.n for r in seen.where("what = 'bigram'").collect()}
        bigrams = {k: max(0.0, raw.get(k, 0.0) + moved.get(k, 0.0)) for k in raw.keys() | moved.keys()}
        rates = {s: {} for s in total}
        for r in seen.where("what = 'use' and kind > 0").collect():
            rates[r.a][r.kind] = (r.n + PRIOR * PRIOR_TOKENS) / (total[r.a] + PRIOR_TOKENS)
        for s, n in total.items():
            for kind in range(1, len(NAMES)):
                rates[s].setdefault(kind, PRIOR * PRIOR_TOKENS / (n + PRIOR_TOKENS))
    return bigrams, rates


def repaired(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, swaps, n_tokens, lost, restored)``: the affected documents and their text put right.

    ``swaps`` names the likeliest swap of each garbled token, and "learned" where the source's own table gives the same letters; ``n_tokens`` counts garbled tokens, ``lost`` the
    characters that were replaced beyond recovery (those keep their mark), and
    ``restored`` is the text with every garbled token replaced.

    Cases: null and empty texts are unaffected; a null source is a source of its
    own; escapes are resolved before a token is judged, and proper ones are no
    case; tokens of several pages in one document are judged one by one; of repeated
    deliveries the last counts; an empty table gives no rows. The driver holds character
    bigrams and one rate per source and swap, whatever the number of documents.
    """
    spark = documents.sparkSession
    some = F.col("text").rlike(r"[^\x00-\x7f]|&#?\w+;|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[0-9a-fA-F]{2}")
    read = documents.where(F.col("doc_id").isNotNull() & some).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), "text", "loaded_at")

    vocabulary = token_counts(read)
    tables = Tables(ciphers(vocabulary))
    bigrams, rates = learn(vocabulary, tables)
    shared = spark.sparkContext.broadcast((bigrams, rates, tables))

    run_id = uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, by_source, own = shared.value
        # what a worker has scored serves its later tasks of the same run; the module's own dictionary, not a pickled copy
        from stratamem.llm.encodings import SCORED as kept

        if run_id not in kept:
            kept.clear()
            kept[run_id] = (Language(grams), {}, defaultdict(dict), own.ciphers(), {s: logs_of(r) for s, r in by_source.items()}, logs_of({}))
        model, known, doubts, cipher, logs, unknown = kept[run_id]

        def options_of(source: str, token: str) -> list[tuple[int, str, float]]:
            options = known.get(token)
            if options is None:
                if len(known) > 300_000:
                    known.clear()
                options = known[token] = scored(token, model)
            return with_learned(options, token, cipher.get(source), model)

        def verdicts(source: str, use: Counter) -> dict[str, tuple[set[int], str]]:
            """The garbled ones of a document's tokens; its own rates start from those of its source."""
            base, at = by_source.get(source, {}), logs.get(source, unknown)
            first = doubts[source]
            doubt = 0.0
            for token, n in use.items():
                p = first.get(token)
                if p is None:
                    if len(first) > 300_000:
                        first.clear()
                    options = options_of(source, token)
                    p = first[token] = sum(p for k, _, p in weighed(options, at) if k) if len(options) > 1 else 0.0
                if p:
                    doubt += p * n
            if doubt < 0.005:
                return {}
            open_ = [(t, n, options) for t, n in use.items() if len(options := options_of(source, t)) > 1]
            could: Counter = Counter()
            for _, n, options in open_:
                for kind, _, _ in options:
                    could[kind] += n
            del could[0]
            for _ in range(DOCUMENT_ROUNDS):
                made = [0.0] * len(NAMES)
                for _, n, options in open_:
                    odds = odds_of(options, at)
                    total = sum(odds)
                    for (kind, _, _), x in zip(options, odds, strict=True):
                        made[kind] += x / total * n
                at = logs_of({k: (DOCUMENT_PRIOR * base.get(k, PRIOR) + made[k]) / (DOCUMENT_PRIOR + c) for k, c in could.items()})
            out = {}
            for token, _, options in open_:
                posterior = weighed(options, at)
                # several swaps may give the same letters
                sums: Counter = Counter()
                for _, letters, p in posterior:
                    sums[letters] += p
                letters = max(sums, key=lambda t: (sums[t], t))
                if letters != token and sums[letters] > 1 / (1 + math.exp(-NATS)):
                    likely = max((p, -k) for k, t, p in posterior if t == letters)[1] * -1
                    out[token] = ({likely} | ({LEARNED} if source in cipher and cipher[source](token) == letters else set()), letters)
            return out

        for batch in batches:
            rows = []
            for doc, source, text, at in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                garbled = verdicts(source, Counter(tokens(text)))
                lost = text.count(LOST)
                if garbled or lost:
                    put = []
                    for part in re.split(r"([ \n\t\r])", text):
                        if not part.isascii() or "&" in part or "\\" in part or "%" in part:
                            part = garbled.get(unescaped(part), (set(), part))[1]
                        put.append(part)
                    kinds = {k for ks, _ in garbled.values() for k in ks}
                    rows.append((doc, source, sorted(NAMES[k] for k in kinds), len(garbled), lost, "".join(put), at.as_py()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), batch.schema.field(3).type]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "source", "swaps", "n_tokens", "lost", "restored", "loaded_at"])

    kind = read.schema["loaded_at"].dataType.simpleString()
    found = read.mapInArrow(judge, f"doc_id bigint, source string, swaps array<string>, n_tokens int, lost int, restored string, loaded_at {kind}")
    last = documents.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("loaded_at").alias("last"))
    newest = found.join(last, "doc_id").where(F.col("loaded_at").eqNullSafe(F.col("last"))).drop("loaded_at", "last")
    return newest.groupBy("doc_id").agg(F.max(F.struct("restored", "source", "swaps", "n_tokens", "lost")).alias("r")).select("doc_id", "r.source", "r.swaps", "r.n_tokens", "r.lost", "r.restored")


def symbol_letters(documents: DataFrame) -> DataFrame:
    """``(source, swap, symbol, letter, tokens)``: the tables of each source, the learned one and those that known swaps seed."""
    spark = documents.sparkSession
    read = documents.select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), "text").where(F.col("text").isNotNull())

    vocabulary = token_counts(read)
    own = ciphers(vocabulary)
    bigrams, rates = learn(vocabulary, Tables(own))
    shared = spark.sparkContext.broadcast((bigrams, rates))

    def letters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, by_source = shared.value
        model, logs, unknown = Language(grams), {s: logs_of(r) for s, r in by_source.items()}, logs_of({})
        for f in frames:
            use: Counter = Counter()
            for source, token, n in zip(f.source, f.token, f.n, strict=True):
                for kind, text, p in weighed(scored(token, model), logs.get(source, unknown)):
                    if kind and p > 0.01:
                        true, read_as = ("utf-8", UTF8_READ_AS[kind - 1]) if kind <= len(UTF8_READ_AS) else SWAPS[kind - 1 - len(UTF8_READ_AS)]
                        for c in set(text):
                            if not c.isascii():
                                try:
                                    symbol = c.encode(true).decode(read_as, "replace")
                                except UnicodeError:
                                    continue
                                if symbol != c:
                                    use[source, NAMES[kind], symbol, c] += n * p
            yield pd.DataFrame([(*k, v) for k, v in use.items()], columns=["source", "swap", "symbol", "letter", "tokens"])

    seeded = vocabulary.mapInPandas(letters, "source string, swap string, symbol string, letter string, tokens double").groupBy("source", "swap", "symbol", "letter").agg(F.round(F.sum("tokens"), 3).alias("tokens"))
    return seeded.unionByName(own.select("source", F.lit(NAMES[LEARNED]).alias("swap"), "symbol", "letter", "tokens"))
