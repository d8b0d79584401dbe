"""Surrogates for personal data: every detected entity gets a keyed replacement of its own kind.

Kinds are e-mail addresses and their domains, phone numbers, card and other long numbers, social security numbers,
IBANs, IPv4 addresses, MAC addresses, access keys, secrets in assignments, and given and family names. A replacement
is made from a keyed hash of the entity's canonical form, so the same entity gets the same one everywhere (a name too,
whatever title or name stands before it), and keeps script, gender, letter case, separators, check digits, country code,
address class and length. A name's gender is what all its titles in the corpus say, if it is no known given name.

Distinctness holds by checks over the whole corpus, on forms as they are written: entities are collected, each proposes
its replacement, and those that propose one taken by another, or one that is itself an entity of the corpus, propose
again with the next attempt, until none collide. Where the entities fill a good part of all values of their format (a
range of private addresses, short numbers), no such search is made: a keyed permutation of the format's values, one
cycle, gives each the next on the cycle; it is distinct by construction and never the entity itself, but it may be
another entity's value. Nearly all settle at attempt 0, which needs no table: texts are rewritten from the key and the
attempts of the others alone, broadcast if they are few and joined by document if not.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.common import Scratch, fresh, join_checked, over_batches, small, text_batches, texts

#: Share of a format's values that entities fill from which they are permuted; below, a proposal clashes at most once in four times.
DENSE = 1 / 8
#: The attempt that stands for the permutation.
PERMUTED = -1
FEISTEL_ROUNDS = 8
#: Rows of the table of later attempts that may be broadcast.
EXCEPTIONS = 50_000

# Given names by script and gender, titles by gender.
GIVEN = {
    ("LATIN", "m"): "James John Robert Michael William David Thomas Daniel Peter Paul Mark George Hans Klaus Jürgen Stefan Pierre Jean Michel Louis Carlos José Juan Miguel Luis Antonio Marco Luca".split(),
    ("LATIN", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Julia Laura Ursula Sabine Petra Claudia Marie Sophie Camille Hélène María Carmen Lucía Elena Sofía Isabel Giulia Chiara".split(),
    ("CYRILLIC", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Борис Олег Павел".split(),
    ("CYRILLIC", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Юлия Вера Галина".split(),
    ("GREEK", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Πέτρος Ανδρέας".split(),
    ("GREEK", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα Ειρήνη Χριστίνα".split(),
}
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don Sig Г-н Κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Г-жа Κυρία".split(), "u": "Dr Prof".split()}
SYLLABLES = {"LATIN": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(), "CYRILLIC": "ба бе во да де ка ко ла ле ма ме на не ра ре ро са се та то".split(), "GREEK": "βα γα δε κα κο λα λε μα με να νε πα πο ρα ρο σα τα το".split()}
FAMILY_END = {"LATIN": ("n", "r", "s", "ck", "ld", "rt"), "CYRILLIC": ("в", "н", "к"), "GREEK": ("ς",)}

_GENDER = {(script, n.casefold()): g for (script, g), names in GIVEN.items() for n in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_CAPITAL = "A-ZÀ-ÖØ-ÞΆΈ-ΏΑ-ΫЀ-Я"
_WORD = rf"[{_CAPITAL}][^\W\d_]+(?:[-’'][^\W\d_]+)*"

PATTERNS: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk-)[A-Za-z0-9]{20,}")),
    ("secret", re.compile(r"(?i)(?:token|passwo?r?d|secret|api[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9+/_.-]{8,})")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("mac", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("number", re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7})(?![\d.]?\d)")),
]
_TITLES = "|".join(sorted(map(re.escape, _TITLE), key=len, reverse=True))
TITLED = re.compile(rf"\b({_TITLES})\.? ({_WORD})(?: ({_WORD}))?")
COMPOUND, PART = re.compile(rf"(?<![^\W\d_]){_WORD}(?![^\W\d_])"), re.compile(r"[^\W\d_]+")
PAIR = re.compile(rf"(?<![^\W\d_])({'|'.join(n for ns in GIVEN.values() for n in ns)}) ({_WORD})")


def script_of(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split()[0]


def _bare(s: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", s)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """Entities (start, end, kind, canonical form, gender that a title gives), in order and apart."""
    found: list[tuple[int, int, str, str]] = []
    if any(c.isdigit() for c in set(text)) or "@" in text or "=" in text or ":" in text:
        for kind, p in PATTERNS:
            for m in p.finditer(text):
                g = 1 if kind == "secret" else 0
                a, b, s = m.start(g), m.end(g), m.group(g)
                if kind == "secret":
                    found.append((a, b, kind, s))
                elif kind == "email":
                    local, _, domain = s.lower().partition("@")
                    cut = a + len(local)
                    found += [(a, cut, "local", f"{local}@{domain}"), (cut + 1, b, "domain", domain)]
                elif kind == "iban":
                    if _mod97(_bare(s)) == 1:
                        found.append((a, b, kind, _bare(s)))
                elif kind == "ip" or kind == "access_key":
                    found.append((a, b, kind, s))
                elif kind == "mac":
                    found.append((a, b, kind, _bare(s).lower()))
                else:
                    found.append((a, b, kind, ("+" if s[0] == "+" else "") + _bare(s)))
    names: list[tuple[int, int, str, str]] = []
    hints: dict[tuple[int, int], str] = {}
    for m in TITLED.finditer(text):
        gender, last = _TITLE[m[1]], m.lastindex
        given = last == 3 or (script_of(m[2]), m[2].casefold()) in _GENDER
        if given:
            names.append((m.start(2), m.end(2), "given", m[2].casefold()))
            hints[m.start(2), m.end(2)] = gender
        if last == 3 or not given:
            names.append((m.start(last), m.end(last), "family", m[last].casefold()))
    for m in PAIR.finditer(text):
        names += [(m.start(1), m.end(1), "given", m[1].casefold()), (m.start(2), m.end(2), "family", m[2].casefold())]
    if names:  # the same names elsewhere in the text, alone or as parts of compound ones
        kinds = {canon: kind for _, _, kind, canon in reversed(names)}
        for m in COMPOUND.finditer(text):
            if m[0].casefold() in kinds:
                names.append((m.start(), m.end(), kinds[m[0].casefold()], m[0].casefold()))
            else:
                names += [(m.start() + w.start(), m.start() + w.end(), kinds[w[0].casefold()], w[0].casefold()) for w in PART.finditer(m[0]) if w[0].casefold() in kinds]
    rank = {k: i for i, k in enumerate(["local", "domain", "access_key", "secret", "iban", "mac", "ip", "phone", "ssn", "number", "given", "family"])}
    out, taken = [], bytearray(len(text))
    for e in sorted({*found, *names}, key=lambda e: (rank[e[2]], e[0], -e[1])):
        if not any(taken[e[0] : e[1]]):
            taken[e[0] : e[1]] = b"\1" * (e[1] - e[0])
            out.append((*e, hints.get(e[:2], "")))
    return sorted(out)


def space_of(kind: str) -> str:
    """Kinds whose replacements must differ from each other: names are one."""
    return "name" if kind in ("given", "family") else kind


def trait(canon: str, given: bool, male: bool, female: bool) -> str:
    """Whether a name is made as a given name, and of which gender."""
    known = _GENDER.get((script_of(canon), canon))
    if known:
        return known
    return ("u" if male == female else "m" if male else "f") if given else ""


class Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.left = key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.n += 1
        v, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return v % n

    def like(self, s: str, hexadecimal: bool = False) -> str:
        """Characters of the same classes; others as they are."""
        out = []
        for c in s:
            if "0" <= c <= "9":
                out.append(str(self.below(10)))
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(6 if hexadecimal else 26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(6 if hexadecimal else 26)))
            else:
                out.append(c)
        return "".join(out)


def format_of(kind: str, canon: str):
    """(format, radices, digits, inverse) of a canonical form of fixed length: its place among the format's values.

    None for kinds whose replacements grow with attempts, and for public addresses.
    """

    def letters(head: str, body: str, hexadecimal: bool, make=None):
        shape, radices, digits = [], [], []
        for c in body:
            for first, last, size in (("0", "9", 10), ("a", "z", 6 if hexadecimal else 26), ("A", "Z", 6 if hexadecimal else 26)):
                if first <= c <= last:
                    shape.append(first)
                    radices.append(size)
                    digits.append(ord(c) - ord(first))
                    break
            else:
                shape.append(c)

        def back(values: list[int]) -> str:
            rest = iter(values)
            made = "".join(chr(ord(c) + next(rest)) if c in ("0", "a", "A") else c for c in shape)
            return make(made) if make else head + made

        return f"{kind}|{head}|{''.join(shape)}", radices, digits, back

    if kind == "ssn":
        return letters("", canon, False)
    if kind == "phone":
        keep = (2 if canon[1] in "17" else 3) if canon[0] == "+" else 0
        return letters(canon[:keep], canon[keep:], False)
    if kind == "mac":
        return letters("", canon, True)
    if kind in ("secret", "access_key"):
        head = next((p for p in ("AKIA", "ASIA", "ghp_", "sk-") if canon.startswith(p)), "")
        body = canon[len(head) :]
        return letters(head, body, bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body)))
    if kind == "iban":
        country = canon[:2]
        return letters(country, canon[4:], False, lambda body: f"{country}{98 - _mod97(country + '00' + body):02d}{body}")
    if kind == "number":
        valid = _luhn(canon) == 0

        def fits(body: str) -> list[str]:
            return [str(d) for d in range(10) if (_luhn(body + str(d)) == 0) == valid]

        name, radices, digits, back = letters(canon[0], canon[1:-1], False)
        radices, digits = [*radices, 1 if valid else 9], [*digits, fits(canon[:-1]).index(canon[-1])]
        return f"{name}|{valid}", radices, digits, lambda v: (body := back(v[:-1])) + fits(body)[v[-1]]
    if kind == "ip":
        own = list(map(int, canon.split(".")))
        a, b = own[:2]
        keep, low = (1, 0) if a in (0, 10, 127) else (2, 0) if (a, b) in ((192, 168), (169, 254)) else (1, 16) if a == 172 and 16 <= b < 32 else (0, 224) if a >= 224 else (4, 0)
        if keep == 4:
            return None
        radices = [256] * (4 - keep)
        if low:
            radices[0] = 16 if low == 16 else 32
        digits = [own[keep] - low, *own[keep + 1 :]]
        return f"ip|{own[:keep]}|{low}", radices, digits, lambda v: ".".join(map(str, [*own[:keep], v[0] + low, *v[1:]]))
    return None


def permuted(key: bytes, kind: str, canon: str) -> str:
    """The next value on a keyed cycle through all values of the entity's format."""
    name, radices, digits, back = format_of(kind, canon)
    n, x = math.prod(radices), 0
    for r, d in zip(radices, digits, strict=True):
        x = x * r + d
    half = max(1, (n - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1

    def f(r: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{name}|{r}|{v}".encode(), key=key, digest_size=-(-half // 8)).digest(), "big") & mask

    def walk(v: int, order, forward: bool) -> int:
        while True:  # a permutation of a power of four, walked until it is back among the values
            left, right = v >> half, v & mask
            for r in order:
                left, right = (right, left ^ f(r, right)) if forward else (right ^ f(r, left), left)
            v = left << half | right
            if v < n:
                return v

    x = walk((walk(x, range(FEISTEL_ROUNDS), True) + 1) % n, range(FEISTEL_ROUNDS - 1, -1, -1), False)
    values = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        values.append(d)
    return back(values[::-1])


def propose(key: bytes, kind: str, canon: str, attempt: int, gender: str = "") -> str:
    """The canonical form of an entity's replacement; gender: of names, empty for family names."""
    if attempt == PERMUTED:
        return permuted(key, kind, canon)
    s = Stream(key, kind, canon, str(attempt))
    if kind == "local":
        local, _, domain = canon.partition("@")
        return f"{s.like(local + 'xq'[:attempt // 8])}@{domain}"  # short names run out: later attempts are longer
    if kind == "domain":
        head, _, top = canon.rpartition(".")
        return f"{s.like(head + 'xqzk'[:attempt // 8])}.{top}"
    if kind in ("secret", "access_key"):
        head = next((p for p in ("AKIA", "ASIA", "ghp_", "sk-") if canon.startswith(p)), "")
        body = canon[len(head) :]
        return head + s.like(body, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body)))
    if kind == "mac":
        return s.like(canon[:1]) + s.like(canon[1:], hexadecimal=True) if canon[0].isdigit() else s.like(canon, hexadecimal=True)
    if kind == "ip":
        a, b = map(int, canon.split(".")[:2])
        keep = [a] if a in (0, 10, 127) else [a, b] if (a, b) in ((192, 168), (169, 254)) else [172, 16 + s.below(16)] if a == 172 and 16 <= b < 32 else [224 + s.below(32)] if a >= 224 else []
        if not keep:
            first = 1 + s.below(223)
            keep = [first if first not in (10, 127, 169, 172, 192) else first + 1]
        return ".".join(map(str, [*keep, *(s.below(256) for _ in range(3 - len(keep))), 1 + s.below(254)]))
    if kind == "iban":
        body = s.like(canon[4:])
        return f"{canon[:2]}{98 - _mod97(canon[:2] + '00' + body):02d}{body}"
    if kind == "number":
        head = canon[0]
        body = head + s.like(canon[1:-1])
        fits = [str(d) for d in range(10) if (_luhn(body + str(d)) == 0) == (_luhn(canon) == 0)]
        return body + fits[s.below(len(fits))]
    if kind == "phone":
        keep = 0
        if canon[0] == "+":
            keep = 2 if canon[1] in "17" else 3
        return canon[:keep] + s.like(canon[keep:])
    if kind == "name":
        script = script_of(canon)
        parts, ends = SYLLABLES.get(script, SYLLABLES["LATIN"]), FAMILY_END.get(script, FAMILY_END["LATIN"])
        of = "mf"[s.below(2)] if gender == "u" else gender
        names = GIVEN.get((script, of))
        if names and attempt < 4:
            return names[s.below(len(names))].casefold()
        made = "".join(parts[s.below(len(parts))] for _ in range(2 + attempt // 3))
        return made + ({"LATIN": "a", "CYRILLIC": "а", "GREEK": "α"}.get(script, "a") if of == "f" else ends[s.below(len(ends))])
    return s.like(canon)


def dress(kind: str, surface: str, canon: str) -> str:
    """A canonical form in the surface form's separators and letter case."""
    if kind in ("phone", "number", "ssn", "iban", "mac"):
        rest = iter(canon.removeprefix("+"))
        out = "".join(next(rest) if c.isalnum() and c.isascii() else c for c in surface)
        return out.upper() if kind == "mac" and surface.upper() == surface else out
    if kind == "local":
        canon = canon.partition("@")[0]
    if kind in ("given", "family"):
        name = canon
        return name.upper() if surface.isupper() and len(surface) > 1 else name.title() if surface[0].isupper() else name
    if kind in ("local", "domain") and surface.upper() == surface and surface.lower() != surface:
        return canon.upper()
    return canon


def rewrite(text: str, key: bytes, known: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with replacements, and the spans (start, end, kind, replacement) in the given text.

    known: attempt and gender of those that are not at attempt 0 or not of the gender their form alone tells.
    """
    out, at, spans = [], 0, []
    for a, b, kind, canon, _ in find(text):
        space = space_of(kind)
        attempt, gender = known.get((space, canon)) or (0, trait(canon, False, False, False) if space == "name" else "")
        new = dress(kind, text[a:b], propose(key, space, canon, attempt, gender))
        out += [text[at:a], new]
        at = b
        spans.append((a, b, kind, new))
    return ("".join([*out, text[at:]]), spans) if spans else (text, spans)


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = {(i, space_of(kind), canon, kind == "given", hint) for i, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for _, _, kind, canon, hint in find(t)}
    cols = list(zip(*rows, strict=True)) if rows else ((),) * 5
    kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "kind", "canon", "given", "hint"])


def _traits(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(kind, canon, gender, plain, format, size): plain, the gender its form alone tells; size, log2 of its format's values."""
    kinds, canons = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    gender, plain, formats, sizes = [], [], [], []
    for k, c, *seen in zip(kinds, canons, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
        gender.append(trait(c, *seen) if k == "name" else "")
        plain.append(trait(c, False, False, False) if k == "name" else "")
        own = None if k in ("name", "local", "domain") else format_of(k, c)
        formats.append(own and own[0])
        sizes.append(own and sum(map(math.log2, own[1])))
    cols = [batch.column(0), batch.column(1), *(pa.array(x, pa.string()) for x in (gender, plain, formats)), pa.array(sizes, pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "canon", "gender", "plain", "format", "size"])


def entities_of(posted: DataFrame) -> DataFrame:
    """(kind, canon, gender, plain, format, size) of postings (kind, canon, given, hint)."""
    seen = posted.groupBy("kind", "canon").agg(F.max("given").alias("given"), F.max(F.col("hint") == "m").alias("male"), F.max(F.col("hint") == "f").alias("female"))
    return over_batches(seen, _traits, "kind string, canon string, gender string, plain string, format string, size double")


def settle(entities: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, canon, gender, plain, attempt, new) for entities as of entities_of.

    new is unique within its kind and no entity of it; of entities that fill their format, unique among them.
    """

    def proposals(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [propose(key, k, c, n, g) for k, c, g, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*names, "new"])

    names = ["kind", "canon", "gender", "plain", "attempt"]
    made = lambda df: over_batches(df.select(*names), proposals, "kind string, canon string, gender string, plain string, attempt int, new string")
    filled = entities.where("format is not null").groupBy("format", "size").agg(F.count("*").alias("n"))
    filled = scratch.save(filled.where(F.log2("n") > F.col("size") + math.log2(DENSE)).select("format", F.lit(PERMUTED).alias("attempt")), files=8)
    entities = join_checked(entities, filled, "format", "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)).cast("int"))
    state = scratch.save(made(entities))
    permuted_ = state.where(F.col("attempt") == PERMUTED)
    state = state.where(F.col("attempt") != PERMUTED)
    taken = entities.select("kind", F.col("canon").alias("new"), F.lit(True).alias("old"))
    while True:  # each round at least three of four settle, of names and addresses all in the end as they grow
        owner = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon")).alias("o"), F.count("*").alias("n")).where("n > 1")
        judged = state.join(taken, ["kind", "new"], "left").join(owner, ["kind", "new"], "left")
        clash = F.coalesce("old", F.lit(False)) | F.coalesce(F.col("o.canon") != F.col("canon"), F.lit(False))
        judged = scratch.save(judged.select(*names, "new", clash.alias("clash")))
        if judged.where("clash").isEmpty():
            return state.union(permuted_)
        again = made(judged.where("clash").withColumn("attempt", F.col("attempt") + 1))
        state = scratch.save(judged.where("not clash").select(*names, "new").union(again))


def replace_entities(docs: DataFrame, key: bytes, exceptions: int = EXCEPTIONS) -> DataFrame:
    """docs (doc_id, text, any other columns) with texts rewritten, plus _entities array<struct<start, end, kind, new>>.

    Offsets count characters of the given text. A null text stays null and holds nothing; texts without entities are
    unchanged; repeated rows are rewritten alike; rows without doc_id are rewritten too. No rows, no result.
    """
    spark, scratch, names = docs.sparkSession, Scratch(docs.sparkSession), docs.columns
    found = "doc_id long, kind string, canon string, given boolean, hint string"
    posted = scratch.save(over_batches(docs.select(F.col("doc_id").cast("long"), "text"), _found, found))
    settled = settle(scratch.save(entities_of(posted)), key, scratch)
    later = scratch.save(settled.where("attempt != 0 or gender != plain").select("kind", "canon", "attempt", "gender"))
    few = small(later, exceptions)
    attempts = spark.sparkContext.broadcast({(r.kind, r.canon): (r.attempt, r.gender) for r in later.collect()}) if few else None
    rows = docs
    if not few:
        own_id, own = fresh("doc", names), fresh("later", names)
        of = posted.select("doc_id", "kind", "canon").distinct().join(later, ["kind", "canon"])
        of = of.groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias(own))
        rows = docs.join(of, docs.doc_id.cast("long").eqNullSafe(F.col(own_id)), "left").drop(own_id)
    text_batches(spark)
    at = names.index("text")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("new", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(b.num_columns - 1).to_pylist() if attempts is None else None
            new, spans = [], []
            for i, t in enumerate(b.column(at).to_pylist()):
                known = attempts.value if own is None else {(x["kind"], x["canon"]): (x["attempt"], x["gender"]) for x in own[i] or ()}
                text, found = rewrite(t, key, known) if t else (t, [])
                new.append(text)
                spans.append([dict(zip(("start", "end", "kind", "new"), s, strict=True)) for s in found])
            cols = [pa.array(new, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, spans_type)], [*names, "_entities"])

    spans_schema = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("new", T.StringType())]))
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_entities", spans_schema)]))
