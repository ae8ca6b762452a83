"""Personal data: fixed patterns and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels the words of each line from features of
the word, its left and its right neighbour, is trained on a small labelled table and decoded
by Viterbi for all lines of a batch at once; it adds spans in spellings that the patterns
miss (national numbers, "name at host dot com", dotted or bracketed addresses).
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistola.llm.common import map_rows, text_of

#: Kinds in the order that breaks ties (fixed values).
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: The base patterns (fixed values).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words with features of their own (fixed values).
CUES = frozenset("at dot com org net example mail email e-mail address write contact tel phone call fax mobile ring number ip host server node from card visa pay account no id ref code token page year line".split())
FEATURES, SLOTS = 4096, 5
LABELLED_WORDS = 200_000
CACHE_WORDS = 100_000

_DIGITS = re.compile(r"[^0-9]")
#: The same matches as EMAIL and IP in time that grows with the text: a match can begin only where a run of its first characters begins.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP_AT_RUN = re.compile(rf"(?<![0-9]){IP.pattern}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL, found from their @ signs outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append((start, free))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches that pass their test, by start, then kind."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in email_spans(text)]
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP_AT_RUN.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return ordered(found)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_EDGE = "\"'`*%$#&|!?,;:<>{}="
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[int, ...]:
    """SLOTS hashed features of a word: shape, digit groups, cue, digit count, signs."""
    core = word.strip(_EDGE)
    shape = re.sub(r"\d+", "9", _LETTERS.sub("x", core))
    groups = re.sub(r"\d+", lambda m: str(len(m[0])), _LETTERS.sub("x", core)) if any(c.isdigit() for c in core) else ""
    bare = core.strip("[](){}.").lower()
    cue = bare if bare in CUES else ""
    n = sum(c.isdigit() for c in core)
    signs = "".join(sorted({c for c in core if c in "@.+-()[]:/"})) + ("b" if core[:1] in "[(" and core[-1:] in "])" else "") + ("z" if n and core.lstrip("([+")[:1] == "0" else "")
    names = (f"s{shape}", f"g{groups}", f"c{cue}{'.' if cue and core.endswith('.') else ''}", f"n{n}", f"p{signs}")
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names)


EDGE_FEATURES = tuple(zlib.crc32(f"edge{i}".encode()) % FEATURES for i in range(SLOTS))


def labelled_sentences(n: int = 700, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The small labelled table in this repository, made by a rule: (word, label) sentences."""
    r = random.Random(seed)
    syllables = "the and tion er in ou est de la que en ung sch ción ment eau ß ä ado".split()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        w = w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.05 else w
        return w + r.choice(["", "", "", "", ",", ".", "***", "%%%", "!!", "$$$", ":"])

    def plain() -> list[tuple[str, str]]:
        odd = [digits(r.randint(1, 6)), digits(16), digits(4) + ".", f"{digits(2)}.{digits(2)}", f'"{"".join(r.choice("0123456789abcdef") for _ in range(r.randint(16, 40)))}"', "token", "=", "|", "-", "at", "dot", f"{digits(3)},", f"{digits(1)}.{digits(1)}.{digits(1)}", f"({digits(1)})", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"p.{digits(2)}", f"({digits(4)})", f"{digits(4)}-{digits(4)}"]
        return [(r.choice(odd) if r.random() < 0.16 else word(), "O") for _ in range(r.randint(1, 7))]

    def tagged(kind: str, words: list[str]) -> list[tuple[str, str]]:
        tail = r.choice(["", "", "", ".", ",", "%%%", "***"])
        words = [*words[:-1], words[-1] + tail]
        return [(w, ("B-" if i == 0 else "I-") + kind) for i, w in enumerate(words)]

    def name() -> str:
        return word().strip(".,*%!$:").lower() + r.choice(["", ".", "_"]) + r.choice(["", digits(2)])

    def entity() -> list[tuple[str, str]]:
        kind = r.choice(KINDS)
        host, end = r.choice(["mail", "post", "web"]) + r.choice(["", digits(1)]), r.choice(["com", "org", "net"])
        if kind == "email":
            at, dot = r.choice([("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)"), ("[at]", "dot")])
            return tagged(kind, r.choice([[f"{name()}@{host}.example.{end}"], [name(), at, host, dot, end], [name(), at, host, dot, "example", dot, end], [f"{name()}{at if at != 'at' else '[at]'}{host}.{end}"]]))
        if kind == "ip":
            p = [str(r.randint(0, 255)) for _ in range(4)]
            return tagged(kind, [r.choice([".", ".", "[.]", "(.)"]).join(p)])
        if kind == "card":
            return tagged(kind, [digits(4) for _ in range(4)])
        lead = r.choice([[], [], [("tel", "O")], [("phone", "O")], [("call", "O")]])
        a, b, c = digits(3), digits(3), digits(4)
        return lead + tagged(kind, r.choice([[f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["00" + digits(2), a, b, c], [f"+{digits(2)}", a, b + c]]))

    rows = []
    for i in range(n):
        sentence = plain()
        for _ in range(r.choice([0, 1, 1, 2]) if i % 3 else 0):
            sentence += entity() + plain()
        rows.append(sentence)
    return rows


#: Spellings of personal data (d: a digit, n: a name, h: a host), sentences around them, and sentences without any: the hand-made part of the labelled table.
SPELLINGS = {
    "phone": (
        "0dd dddd dddd", "0dddd dddddd", "0ddd ddd dddd", "(0dd) dddd dddd", "(0dddd) dddddd", "0dd/dddddd", "0ddd-dddddd", "(0)dd dddddd", "0d dd dd dd dd", "9dd ddd ddd", "ddd-ddd-dddd",
        "(ddd) ddd-dddd", "0dddddddddd", "0ddd/ddddddd", "ddd.ddd.dddd", "00dd dd dddd dddd", "0dd ddd dd dd", "1-ddd-ddd-dddd", "00dd (0)ddd dddddd", "0ddd dddddd", "0dd dddddd", "0ddd ddd ddd", "0dddd ddd ddd",
    ),
    "email": (
        "n at h dot com", "n AT h DOT com", "n at h dot co dot uk", "n (at) h (dot) de", "n [at] h [dot] org", "n(at)h.de", "n[at]h.net", "n At h Dot org", "n AT h DOT co DOT uk", "n [at] h.com", "n (at) h.fr",
        "n dot n at h dot com", "n at h dot ac dot nz", "n(at)h(dot)com", "n[AT]h[DOT]net", "n at h dot gov dot au",
    ),
    "ip": ("d[.]d[.]d[.]d", "dd(.)dd(.)dd(.)dd", "ddd[.]ddd[.]d[.]dd", "10[.]d[.]d[.]dd", "192.168.d[.]dd"),
    "card": ("dddd.dddd.dddd.dddd", "dddd/dddd/dddd/dddd", "dddd_dddd_dddd_dddd"),
}
AROUND = (
    "Please call # before noon", "You can reach me on # or at the office", "My number is # and I am in all day", "Rufen Sie bitte # an", "Tel. #", "Telefon: #", "Téléphone # entre 9 et 12 heures",
    "Llame al # por la tarde", "If in doubt, contact # for help", "She wrote it down as # on a card", "Fax # , second floor", "Office: #", "Write to # with your questions", "Mail # and ask for Jane",
    "The address # belongs to our host", "He left # on the form", "Schreiben Sie an # oder kommen Sie vorbei", "Contact: #", "Send the signed copy to # this week", "It is registered under # since May",
    "# is the best way to get hold of him", "Ask for the manager ( # )", "home # , work the same", "Reply to # , please", "In an emergency ring # at once", "The server logged # twice", "They paid with # last month",
)
PLAIN = (
    "The meeting is on 12 03 2024 at 08:30 in room 0114", "Order 0045 of 1200 units was shipped on 2024-05-17", "The price rose by 1 200 000 EUR to 3.5 million", "See chapter 12 , pages 120 to 130 , and table 4.2.1",
    "Invoice 2024-00123 is due within 30 days", "He looked at the dot on the map for 5 minutes", "Look at line 40 dot the i and go on", "We met at noon at the station near platform 9", "In 1999 about 250 000 people lived there",
    "The ratio was 0.75 in 2019 and 0.81 in 2020", "Section 14 (2) of the act of 1996 applies", "Version 10.2.1 was released on 03/04/2021", "Item no. 00871 costs 14.99 and weighs 0.5 kg", "They arrived at gate 22 at 17:45",
    "ISBN 978 3 16 148410 0 is out of print", "The report counts 1,234 cases in 56 towns", "Flight 0815 leaves at 06:05 from gate 11", "Ref. 0077/2024 was closed", "A dot at the end of the line marks the limit", "Der Preis betrug 1.250,00 Euro am 01.02.2020",
    "Room 101 is at the end", "Between 2001 and 2015 the budget grew by 30 %", "Part number 4711-0815 is on page 3", "Code 404 means that nothing was found at the address", "Postcode 75008 Paris , 12 rue Royale", "It took 3 hours 25 minutes and 10 seconds",
    "The score was 3 to 2 at half time", "Add 250 g of flour and 0.5 l of milk", "Top 10 at a glance : 7 , 8 and 9", "Das Treffen ist um 14.30 Uhr in Raum 0203", "Chapter 3 dot 4 is at the back of the book",
)
NAMES = ("jane", "j.doe", "info", "sales", "m_rossi", "office42", "anna.k", "support", "pierre", "k.mueller", "bob", "hello", "team7", "maria.g", "x.y")
HOSTS = ("acme", "example", "widgets", "north-sea", "uni", "mail", "bakery", "test", "firm24", "studio", "garage", "lawyers")


def spelled_sentences(n: int = 700, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Sentences of the hand-made lists with labels: every other one with personal data in a spelling that the patterns miss."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 2:
            rows.append([(w, "O") for w in re.sub(r"[0-9]", lambda m: r.choice("0123456789") if r.random() < 0.3 and m[0] != "0" else m[0], r.choice(PLAIN)).split()])
            continue
        kind = r.choice(["phone"] * 4 + ["email"] * 4 + ["ip", "card"])
        spelled = r.choice(SPELLINGS[kind])
        if kind == "email":
            spelled = re.sub(r"(?<![a-z])[nh](?![a-z])", lambda m: r.choice(NAMES if m[0] == "n" else HOSTS), re.sub(r"(?<=[\])])h|n(?=[\[(])", lambda m: r.choice(NAMES if m[0] == "n" else HOSTS), spelled))
        else:
            spelled = re.sub("d", lambda m: r.choice("0123456789" if kind != "ip" else "1234567890"), spelled)
        sentence: list[tuple[str, str]] = []
        for w in r.choice(AROUND).split():
            if w != "#":
                sentence.append((w, "O"))
                continue
            words = spelled.split()
            words[-1] += r.choice(["", "", "", ".", ","])
            sentence += [(x, ("B-" if j == 0 else "I-") + kind) for j, x in enumerate(words)]
        rows.append(sentence)
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """labelled_sentences and spelled_sentences as a table: sentence, position, word, label."""
    rows = [(i, j, w, y) for i, s in enumerate([*labelled_sentences(), *spelled_sentences()]) for j, (w, y) in enumerate(s)]
    return spark.createDataFrame(rows, "sentence long, position long, word string, label string")


class Field:
    """A linear-chain conditional random field; weights are arrays [3 places, features, labels] and [labels, labels]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit.astype(np.float32), move.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        """Start without known words; row 0 of the table stands for what lies beyond a line."""
        self.cache.clear()
        self.words: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((256, 3, len(LABELS)), np.float32)
        self._add(EDGE_FEATURES)

    def _add(self, ids: tuple[int, ...]) -> int:
        at = self.words.setdefault(ids, len(self.words))
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if at == len(self.words) - 1:
            self.table[at] = self.emit[:, list(ids)].sum(axis=1)
        return at

    @classmethod
    def train(cls, sentences: list[list[tuple[str, str]]], epochs: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Field:
        """Maximum likelihood by Adam over all sentences at once, with forward-backward in log space."""
        k, n = len(LABELS), len(sentences)
        length = np.array([len(s) for s in sentences])
        steps = int(length.max())
        x = np.empty((n, steps, 3, SLOTS), np.int64)
        x[:] = EDGE_FEATURES
        y = np.zeros((n, steps), np.int64)
        for i, s in enumerate(sentences):
            f = [features(w) for w, _ in s]
            for j, (_, label) in enumerate(s):
                x[i, j, 0] = f[j]
                if j:
                    x[i, j, 1] = f[j - 1]
                if j + 1 < len(s):
                    x[i, j, 2] = f[j + 1]
                y[i, j] = LABELS.index(label)
        mask = np.arange(steps) < length[:, None]
        flat = x + (np.arange(3) * FEATURES)[:, None]
        w, m = np.zeros((3 * FEATURES, k)), np.zeros((k, k))
        gold_w, gold_m = np.zeros_like(w), np.zeros_like(m)
        np.add.at(gold_w, flat[mask].reshape(mask.sum(), -1), np.eye(k)[y[mask]][:, None, :])
        pair = mask[:, 1:]
        np.add.at(gold_m, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        state = [(np.zeros_like(a), np.zeros_like(a)) for a in (w, m)]

        def lse(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        for epoch in range(1, epochs + 1):
            e = w[flat.reshape(n, steps, -1)].sum(axis=2)
            alpha, beta = np.zeros((steps, n, k)), np.zeros((steps, n, k))
            alpha[0] = e[:, 0]
            for t in range(1, steps):
                new = lse(alpha[t - 1][:, :, None] + m, 1) + e[:, t]
                alpha[t] = np.where(mask[:, t, None], new, alpha[t - 1])
            z = lse(alpha[-1], 1)
            for t in range(steps - 2, -1, -1):
                new = lse(m + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(mask[:, t + 1, None], new, 0)
            p = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
            exp_w, exp_m = np.zeros_like(w), np.zeros_like(m)
            np.add.at(exp_w, flat[mask].reshape(mask.sum(), -1), p[mask][:, None, :])
            for t in range(1, steps):
                on = mask[:, t]
                exp_m += np.exp(alpha[t - 1][on][:, :, None] + m + (e[on, t] + beta[t][on])[:, None, :] - z[on][:, None, None]).sum(axis=0)
            for a, grad, (first, second) in zip((w, m), ((gold_w - exp_w) / n - decay * w, (gold_m - exp_m) / n - decay * m), state, strict=True):
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                a += rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
        return cls(w.reshape(3, FEATURES, k), m)

    def decode(self, lines: list[list[str]]) -> dict[int, np.ndarray]:
        """Best labels of the lines that have any but O."""
        if max(len(self.cache), len(self.words)) > CACHE_WORDS:
            self._forget()
        get = self.cache.__getitem__
        length = np.array([len(s) for s in lines], np.int64)
        if not length.sum():
            return {}
        order = np.argsort(-length, kind="stable")
        order = order[: np.count_nonzero(length)]
        size = length[order]
        ids = np.array([get(w) for i in order for w in lines[i]], np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        left, right = np.empty_like(ids), np.empty_like(ids)
        left[1:], right[:-1] = ids[:-1], ids[1:]
        left[first], right[first + size - 1] = 0, 0
        e = self.table[ids, 0] + self.table[left, 1] + self.table[right, 2]
        best = e[first].copy()
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # lines longer than t
        back = [None] * steps
        for t in range(1, steps):
            a = active[t]
            score = best[:a, :, None] + self.move
            back[t] = score.argmax(axis=1).astype(np.uint8)
            best[:a] = score.max(axis=1) + e[first[:a] + t]
        path = np.empty(len(ids), np.uint8)
        now = best.argmax(axis=1)
        path[first + size - 1] = now
        for t in range(steps - 1, 0, -1):
            a = active[t]
            now[:a] = back[t][np.arange(a), now[:a]]
            path[first[:a] + t - 1] = now[:a]
        out = {}
        for i in np.flatnonzero(np.maximum.reduceat(path, first)):
            out[int(order[i])] = path[first[i] : first[i] + size[i]]
        return out

    @property
    def cache(self) -> dict:
        made = self.__dict__.get("_cache")
        if made is None:
            field = self

            class Cache(dict):
                def __missing__(self, word: str) -> int:
                    self[word] = at = field._add(features(word))
                    return at

            made = self.__dict__["_cache"] = Cache()
        return made


_WORD = re.compile(r"\S+")
_SPELLED = re.compile(r"[\w.%+-]+( dot [\w.%+-]+)*(@| ?[\[(]at[\])] ?| at )[\w-]+((\.| ?[\[(]dot[\])] ?| dot )[\w-]+)+", re.IGNORECASE)
_OUTSIDE = "\"'`*%$#&|!?,;:<>{}=."


#: What a line must hold for any span to pass _valid(): four digits, or an @ sign in some spelling. Other lines need no decoding.
_POSSIBLE = re.compile(r"(?:\d\D*){4}|@|[\[(]at[\])]| at ", re.IGNORECASE)


def _valid(kind: str, text: str) -> bool:
    digits = _DIGITS.sub("", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", text)
    if kind == "ip":
        parts = re.findall(r"\d+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^\W\d_]", text)
    return bool(_SPELLED.fullmatch(text))


def field_spans(line: str, at: int, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of one labelled line that begins at character `at`; words trimmed of outer signs, then tested."""
    places = [m.span() for m in _WORD.finditer(line)]
    spans, i = [], 0
    while i < len(labels):
        name = LABELS[labels[i]]
        if name == "O":
            i += 1
            continue
        j = i + 1
        while j < len(labels) and LABELS[labels[j]] == f"I-{name[2:]}":
            j += 1
        start, end = places[i][0], places[j - 1][1]
        body = line[start:end]
        start += len(body) - len(body.lstrip(_OUTSIDE))
        end -= len(body) - len(body.rstrip(_OUTSIDE))
        if start < end and _valid(name[2:], line[start:end]):
            spans.append((name[2:], at + start, at + end))
        i = j
    return spans


def find(docs: DataFrame, labelled: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_email, n_ip, n_card, n_phone, base_sha256, spans to docs.

    Counts and digest are of the base spans; spans holds them and those that the field adds
    where no base span lies, as kind:start:end in characters. At most LABELLED_WORDS labelled
    words train the field. Null and empty texts have no spans; an empty table gives an empty
    table; columns with the names of new ones are replaced.
    """
    sentences: dict[int, list] = {}
    for r in labelled.orderBy("sentence", "position").limit(LABELLED_WORDS).collect():
        sentences.setdefault(r["sentence"], []).append((r["word"], r["label"]))
    field = Field.train(list(sentences.values()))
    shared = docs.sparkSession.sparkContext.broadcast((field.emit, field.move))
    new = [*[(f"n_{k}", T.LongType()) for k in KINDS], ("base_sha256", T.StringType()), ("spans", T.StringType())]

    def make():
        field = Field(*shared.value)
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

        def work(texts):
            base = [base_spans(t) for t in texts]
            lines, place = [], []
            for i, t in enumerate(texts):
                at = 0
                for line in t.split("\n"):
                    if _POSSIBLE.search(line):
                        lines.append(line.split())
                        place.append((i, at, line))
                    at += len(line) + 1
            every = [list(b) for b in base]
            for number, labels in field.decode(lines).items():
                i, at, line = place[number]
                every[i] += [s for s in field_spans(line, at, labels) if all(s[2] <= a or s[1] >= b for _, a, b in base[i])]
            counts = [[sum(k == kind for k, *_ in b) for b in base] for kind in KINDS]
            digests = [hashlib.sha256(write(b).encode()).hexdigest() for b in base]
            return [*counts, digests, [write(ordered(s)) for s in every]]

        return work

    return map_rows(docs, [text_of(text)], new, make, keep)
