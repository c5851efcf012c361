"""Personal information in free text: find it and replace it by typed placeholders.

Anchor expansion: one pass of an Aho-Corasick automaton over a text finds the anchors, and at each of them a deterministic local parser
expands to the item's boundaries and validates it; nothing else reads the text. Anchors are

* at-signs and their disguises, for e-mails, remotes and handles; schemes and slashes, for addresses of the net and paths, which shield their text;
* cues of identity numbers, and letters or digits that meet digits as they do in such numbers;
* types of streets (words in English and French, endings of words in German);
* plus signs, opened brackets and separators between digits, and cues of telephones;
* the parts of registered persons' names, and cues, titles, greetings and signatures that names follow.

A later item never overlaps an earlier, stronger one: schemes and
remotes protect their text, then e-mails, paths, handles, identity numbers, addresses, telephones and names.

Names come from the member registry: given names and surnames as registered, and surnames put together from
two parts that are each productive in it. The distinct name parts are broadcast if there are at most
``MAX_NAME_PARTS`` names. Beyond that the same parts are worked out as tables and the words of the texts are joined with them; the results
are the same. A name that the registry doesn't suggest is found after a cue only (``Dear``, ``contact``, ``Mr``), as capitalised words.

Defined results
---------------
* Null, empty and blank texts hold nothing; null ids are kept as null.
* Repeated rows give one row for each id and type.
* Texts of any length are scanned whole, in time in proportion to their length and the number of anchors.
* Overlapping candidates: the first in the order above holds. Ties within a type go to the one that begins first.
* Without a registry (empty table) only names beside cues are found; other types are unaffected.
* Extra columns, also named like the outputs, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "id_number", "address", "phone", "name")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
MAX_NAME_PARTS = 200_000

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?|\sdot\s)"
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_PATH = re.compile(r"(?<![\w/])(?:~|\.{0,2})/(?:[\w.@+-]+/)+[\w.@+-]*")
_HANDLE = re.compile(r"(?<![\w.+-])@[A-Za-z][\w.-]*(?:/[\w.-]+)*")

ID_CUES = (
    "ssn", "social security", "passport", "driver licence", "driver license", "driver's licence", "driver's license", "driving licence", "driving license",
    "national id", "tax id", "taxpayer id", "identity card", "identity number", "id card", "national insurance", "personal id", "steuer-id", "personalausweis", "nino",
)  # fixed values
_ID_AFTER = re.compile(r"[\s:=#\"'(-]{0,4}(?:(?:no|number|nr|num|card|code)\b\.?[\s:=#\"'-]{0,4}){0,2}([A-Z]{0,3}[ -]?\d[\dA-Z]*(?:[ -]\d[\dA-Z]*){0,4}(?:[ -][A-Z]\b)?)(?![A-Za-z0-9])", re.I)
_ID_BARE = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-])")

STREETS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "crescent", "cres", "drive", "court", "boulevard", "blvd", "way", "place", "square", "terrace", "close", "row", "grove", "gardens",
)  # fixed values
GERMAN_STREETS = ("weg", "straße", "strasse", "str.", "allee", "gasse", "platz", "ring", "damm", "ufer")  # fixed values
FRENCH_STREETS = ("rue", "avenue", "boulevard", "place", "chemin", "quai", "allée", "impasse", "cours")  # fixed values
_EN_STREET = re.compile(
    r"(?<![\w.-])(?:(?:flat|apt|apartment|unit|suite)\.? ?\d+[A-Za-z]?,? )?\d{1,5}[A-Za-z]?,? (?:[NSEW]{1,2}\.? )?(?:[A-Z][\w-]*(?:['’][\w-]+)* |[A-Z][A-Za-z]{0,2}\. ){1,3}(?:" + "|".join(STREETS) + r")\b\.?"
    r"(?:,? (?:suite|apt|apartment|unit|flat|floor)\.? ?\d+[A-Za-z]?)?"
    r"(?:,? (?:[A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*)(?: [A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*)?(?:,? \d{4,5})?)?"
)
_DE_STREET = re.compile(r"(?<![\w-])[A-ZÄÖÜ][\wäöüß-]*(?i:" + "|".join(map(re.escape, GERMAN_STREETS)) + r") \d{1,4}[a-z]?\b(?:, (?:\d{4,5} )?[A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*(?: [A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*)?)?")
_FR_STREET = re.compile(r"(?<![\w.-])\d{1,4}(?: (?i:bis|ter))?,? (?i:" + "|".join(FRENCH_STREETS) + r") (?:(?i:de la|de l['’]|des|du|de|d['’]|la|le|les) ?)?[A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*(?: [A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*)?(?:, (?:\d{4,5} )?[A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*(?: [A-ZÀ-Þ][\w-]*(?:['’][\w-]+)*)?)?")

_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(0?\d{1,4}\))?(?:[ .-]?\d{1,5}){2,5}"
    r"|\([2-9]\d{2}\)[ -]?\d{3}[ .-]\d{4}"
    r"|[2-9]\d{2}([ .-])\d{3}\1\d{4}"
    r"|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,4}/\d{5,8}"
    r")(?:,? ?(?:ext|x|extension)\.? ?\d{1,5})?(?![\w-]|\.\d)",
    re.I,
)
PHONE_CUES = ("telephone", "phone", "mobile", "whatsapp", "cell", "tel", "mob", "fax")  # fixed values
_AFTER_PHONE_CUE = re.compile(r"(?!\w)[.:=]? ?(?:no\.?|number)? ?[:=]? ?(\+?\(?\d[\d ().-]{6,16}\d)(?![\w-]|\.\d)", re.I)
_EXTENSION = re.compile(r"[ ,]*(?:ext|x)", re.I)
_INITIAL = re.compile(r"[ ]([A-Z])\.(?!\w)")
NAME_CUES = ("mr", "mrs", "ms", "dr", "prof", "dear", "contact", "regards", "sincerely")  # fixed values
_AFTER_NAME_CUE = re.compile(r"(?<=[a-z])[.,]?[ \n]{1,2}([A-ZÀ-Þ][^\W\d_A-Z]+(?:['’-][A-ZÀ-Þ]?[^\W\d_A-Z]+)*(?: [A-Z]\.)?(?:[ ](?:(?:van|von|de|di|da|del|la|le) )?[A-ZÀ-Þ][^\W\d_A-Z]+(?:['’-][A-ZÀ-Þ]?[^\W\d_A-Z]+)*){1,2})(?![\w@/\\])")
_FRENCH_NUMBER = re.compile(r"(?<![\w.-])\d{1,4}(?: (?:bis|ter))?,? $", re.I)
_ENGLISH_START = re.compile(r"(?<![\w.-])(?:(?:flat|apt|apartment|unit|suite)\b|\d)", re.I)
_GERMAN_LETTER = re.compile(r"[\wäöüß-]")
_BETWEEN_NAMES = re.compile(r",? |-|\xa0| [A-Z]\. ")
_INITIAL_BEFORE = re.compile(r"(?<!\w)[A-Z]\. $")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]{2,})?")


def name_parts(names: list[str]) -> tuple[set[str], set[str]]:
    """Lower-cased parts of registered names, and surnames made of two parts that are each productive among them."""
    parts = {w.lower() for n in names for w in _WORD.findall(n) if len(w) > 2}
    last = {w.lower() for n in names if len(ws := _WORD.findall(n)) > 1 for w in ws[1:] if len(w) > 4}
    heads: Counter = Counter()
    tails: Counter = Counter()
    for s in last:
        for k in range(3, len(s) - 1):
            heads[s[:k]] += 1
            tails[s[k:]] += 1
    cuts = [max(range(3, len(s) - 1), key=lambda k, s=s: (heads[s[:k]] * tails[s[k:]], k)) for s in last if len(s) > 4]
    pairs = [(s[:k], s[k:]) for s, k in zip([s for s in last if len(s) > 4], cuts, strict=True)]
    firsts, seconds = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    return parts, {a + b for a, n in firsts.items() if n >= 4 for b, m in seconds.items() if m >= 4} - parts


def _anchors(names: set[str]) -> dict[str, list[str]]:
    """Every anchor in lower case, with its kinds."""
    digits = "0123456789"
    kinds = {
        "at": ["@", "＠", "%40", "(at)", "[at]", "{at}", " at ", "( at )"], "scheme": ["://"], "slash": ["/"], "id": ID_CUES, "letters": [a + sep + d for a in "abcdefghijklmnopqrstuvwxyz" for sep in ("", " ") for d in digits],
        "digits": [*(a + sep + d for a in digits for sep in " .-/" for d in digits), *("(" + d for d in digits), *("+" + d for d in digits)], "tel": PHONE_CUES,
        "en": STREETS, "de": [x + " " for x in GERMAN_STREETS], "fr": [x + " " for x in FRENCH_STREETS], "who": NAME_CUES, "name": names,
    }
    out: dict[str, list[str]] = {}
    for kind, words in kinds.items():
        for w in words:
            out.setdefault(w, []).append(kind)
    return out


class _Taken:
    """The places of a text that belong to an item or are shielded: a byte a character, so that asking and taking cost the span's length."""

    def __init__(self, length: int) -> None:
        self.marks = bytearray(length)

    def free(self, s: int, e: int) -> bool:
        return self.marks.find(1, s, e) < 0

    def take(self, s: int, e: int) -> None:
        self.marks[s:e] = b"\x01" * (e - s)


class Finder:
    """Finds the items of one text; built once a Python worker."""

    def __init__(self, parts: set[str], made: set[str]) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for a, kinds in _anchors(parts | made).items():
            self.auto.add_word(a, (tuple(kinds), len(a)))
        self.auto.make_automaton()

    def spans(self, text: str, names: set[str] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, type), sorted, without overlaps; names: further name parts to look for."""
        low = text.lower()
        if len(low) != len(text):  # some letters grow when lowered
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        hits: dict[str, list[tuple[int, int]]] = {}
        for end, (kinds, n) in self.auto.iter(low):
            for kind in kinds:
                hits.setdefault(kind, []).append((end - n + 1, end + 1))
        for w in names or ():
            at = low.find(w)
            while at >= 0:
                hits.setdefault("name", []).append((at, at + len(w)))
                at = low.find(w, at + 1)
        if not hits:
            return []
        taken = _Taken(len(text))
        found: list[tuple[int, int, str]] = []

        def add(s: int, e: int, kind: str) -> None:
            if taken.free(s, e):
                taken.take(s, e)
                found.append((s, e, kind))

        for s, e in hits.get("scheme", ()):
            if taken.marks[s]:
                continue
            while s > 0 and (low[s - 1].isascii() and low[s - 1].isalnum() or low[s - 1] in "+.-") and not taken.marks[s - 1]:
                s -= 1
            while not low[s].isalpha() and low[s] != ":":
                s += 1
            taken.take(s, _TO_SCHEME_END.match(text, e).end())
        for s, e in hits.get("at", ()):
            if not taken.marks[s]:
                self._email(text, s, e, taken, add)
        past = 0
        for s, _ in hits.get("slash", ()):
            if s >= past:
                while s > 0 and s > past and (text[s - 1] == "." and text[s : s + 1] in "./" and text[s : s + 2] != ".." or text[s - 1] == "~" and text[s] == "/"):
                    s -= 1
                m = _PATH.match(text, s)
                if m:
                    past = m.end()
                    if taken.free(*m.span()):
                        taken.take(*m.span())
        for s, e in hits.get("at", ()):
            if text[s:e] == "@" and (m := _HANDLE.match(text, s)) and taken.free(*m.span()):
                taken.take(*m.span())
        for s, e in hits.get("id", ()):
            if not low[s - 1 : s].isalnum() and (m := _ID_AFTER.match(text, e)) and sum(map(str.isdigit, m[1])) >= 6:
                add(*m.span(1), "id_number")
        starts = self._number_starts(text, hits)
        past = 0
        for s in starts:
            if s >= past and (m := _ID_BARE.match(text, s)):
                past = m.end()
                add(*m.span(), "id_number")
        self._addresses(text, hits, add, taken)
        past = 0
        for s in starts:
            if s >= past and (m := _PHONE.match(text, s)):
                past = m.end()
                if 9 <= sum(map(str.isdigit, _EXTENSION.split(m[0])[0])) <= 15:
                    add(*m.span(), "phone")
        for s, e in hits.get("tel", ()):
            if not (low[s - 1 : s].isalnum() or low[s - 1 : s] == "_") and (m := _AFTER_PHONE_CUE.match(text, e)) and 7 <= sum(map(str.isdigit, m[1])) <= 15:
                add(*m.span(1), "phone")
        for s, e in hits.get("who", ()):
            if not (low[s - 1 : s].isalnum() or low[s - 1 : s] in ("_", "-", "/", "@", ".")) and (m := _AFTER_NAME_CUE.match(text, e)):
                add(*m.span(1), "name")
        self._names(text, low, hits.get("name", ()), taken, found)
        return sorted(found)

    @staticmethod
    def _number_starts(text: str, hits: dict) -> list[int]:
        """Where telephones and identity numbers may begin: at the sign, bracket, letters or first digit that an anchor belongs to."""
        starts = set()
        low = -1  # digits before it were expanded by an earlier anchor
        for s, _ in hits.get("digits", ()):
            if text[s].isdigit():
                at = s
                while s > 0 and s - 1 > low and text[s - 1].isdigit():
                    s -= 1
                low = at
            starts.add(s)
        for s, _ in hits.get("letters", ()):
            if s > 0:
                starts.add(s - 1)
        return sorted(starts)

    @staticmethod
    def _email(text: str, s: int, e: int, taken: _Taken, add) -> None:
        sign = text[s:e]
        word = sign.strip().lower() == "at"
        left, right = s, e
        if sign not in ("@", "%40"):
            while left > 0 and text[left - 1] == " ":
                left -= 1
            while right < len(text) and text[right] == " ":
                right += 1
        a = left
        while a > 0 and (text[a - 1].isascii() and text[a - 1].isalnum() or text[a - 1] in "._+-" or text[a - 1] == "%" and text[a : a + 2] != "40"):
            a -= 1
        while a < left and not text[a].isalnum():
            a += 1
        domain = _DOMAIN.match(text, right) if a < left else None
        if domain is None or word and " dot " not in domain[0].lower() and "dot" not in re.sub(r"[^a-z ]", " ", domain[0].lower()).split():
            return
        b = domain.end()
        if text[b : b + 1] == ":" and _REMOTE.match(text, b) and sign == "@" or text[b : b + 1] == "/" and text[a:left] == "git":
            taken.take(a, _TO_REMOTE_END.match(text, b).end())
            return
        add(a, b, "email")

    @staticmethod
    def _addresses(text: str, hits: dict, add, taken: _Taken) -> None:
        past = 0
        for s, e in hits.get("de", ()):
            if text[e : e + 1].isdigit():
                while s > past and _GERMAN_LETTER.match(text[s - 1]):
                    s -= 1
                if m := _DE_STREET.match(text, s):
                    past = m.end()
                    add(*m.span(), "address")
        for s, _ in hits.get("fr", ()):
            if (n := _FRENCH_NUMBER.search(text, max(0, s - 16), s)) and (m := _FR_STREET.match(text, n.start())):
                add(*m.span(), "address")
        past = 0
        for s, e in hits.get("en", ()):
            if s < past or text[s - 1 : s] != " " or text[e : e + 1].isalnum() or text[e : e + 1] == "_":
                continue
            at = s - 1
            for _ in range(8):  # a flat and its number, the house number, a direction, and up to three words
                at = text.rfind(" ", past, at) if at > past else -1
                if at < 0:
                    break
            for start in _ENGLISH_START.finditer(text, max(at, past), s):
                m = _EN_STREET_I.match(text, start.start())
                if m and m.end() >= e:
                    past = m.end()
                    add(*m.span(), "address")
                    break

    @staticmethod
    def _names(text: str, low: str, hits, taken: _Taken, found: list) -> None:
        run: list[list[int]] = []
        for s, e in sorted(hits):
            before, after = text[s - 1 : s], text[e : e + 1]
            if before.isalpha() or after.isalpha():
                continue
            if before in ("'", "’") and text[s - 2 : s - 1].isalpha() and s > 1 and text[s + 1 : s + 2].isalpha():
                continue  # inside a word with an apostrophe
            if after in ("'", "’") and after and text[e + 1 : e + 2].isalpha() and text[e + 2 : e + 3].isalpha():
                continue
            if not taken.free(s, e):  # a name inside an e-mail or path is none
                continue
            if before in ("_", "@", "/", "\\", "+") and before or after in ("_", "@", "/", "\\") and after or before.isdigit() or after.isdigit() or before == "." and s > 1 and text[s - 2].isalnum() or after == "." and text[e + 1 : e + 2].isalnum():
                continue
            if run and _BETWEEN_NAMES.fullmatch(text, run[-1][1], s):
                run[-1][1] = e
            else:
                run.append([s, e])
        for s, e in run:
            if m := _INITIAL.match(text, e):
                e = m.end()
            elif _INITIAL_BEFORE.search(text, max(0, s - 4), s) and taken.free(s - 3, s):
                s -= 3
            if taken.free(s, e):
                taken.take(s, e)
                found.append((s, e, "name"))


_REMOTE = re.compile(r":[\w~/.-]")
_TO_SCHEME_END, _TO_REMOTE_END = re.compile(r"[^\s\"'<>)\]]*"), re.compile(r"[^\s\"'<>)]*")
# English streets by capitalised words, or the whole in capitals; only the type of street may be in any case
_EN_STREET_I = re.compile(_EN_STREET.pattern.replace("(?:" + "|".join(STREETS) + ")", "(?i:" + "|".join(STREETS) + ")").replace("(?:flat|apt|", "(?i:flat|apt|").replace("(?:suite|apt|", "(?i:suite|apt|"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each item replaced; all else is unchanged."""
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join([*out, text[at:]])


def _registered(members: DataFrame) -> DataFrame:
    return members.select(F.trim("name").alias("name")).where("name IS NOT NULL AND name <> ''").distinct()


_PART = r"([^\W\d_]+(?:['’][^\W\d_]{2,})?)"


def _name_words(names: DataFrame, words: DataFrame) -> DataFrame:
    """The words (w) that are parts of registered names, or surnames made of two parts that are each productive among them, as ``name_parts`` has them."""
    from glintflow.session import checkpointed

    held = F.regexp_extract_all(F.lower("name"), F.lit(r"(?U)" + _PART), 1)
    parts = checkpointed(names.select(held.alias("p")).select("p", F.size("p").alias("n")))
    single = parts.select(F.explode("p").alias("w")).where("length(w) > 2").distinct()
    last = parts.where("n > 1").select(F.explode(F.slice("p", 2, F.col("n") - 1)).alias("w")).where("length(w) > 4").distinct()
    cut = lambda df: df.select("w", F.explode(F.sequence(F.lit(3), F.length("w") - 2)).alias("k")).select("w", "k", F.expr("substring(w, 1, k)").alias("a"), F.expr("substring(w, k + 1)").alias("b"))
    cuts = cut(last)
    heads, tails = cuts.groupBy("a").agg(F.count(F.lit(1)).alias("na")), cuts.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    best = checkpointed(cuts.join(heads, "a").join(tails, "b").groupBy("w").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("na") * F.col("nb"), "k")).alias("c")))
    productive = lambda side: best.groupBy(F.col(f"c.{side}").alias(side)).agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select(side)
    made = cut(words.where("length(w) > 4")).join(productive("a"), "a", "left_semi").join(productive("b"), "b", "left_semi").select("w")
    return words.join(single.unionByName(made).distinct(), "w", "left_semi")


def _scan(rows: DataFrame, members: DataFrame, what: str) -> DataFrame:
    """Adds ``_out`` to rows with ``_t``: the types found, or the redacted text."""
    spark = rows.sparkSession
    names = [r[0] for r in _registered(members).limit(MAX_NAME_PARTS + 1).collect()]  # a list of checked size
    small = len(names) <= MAX_NAME_PARTS
    shared = spark.sparkContext.broadcast(name_parts(names) if small else (set(), set()))

    @F.pandas_udf("array<string>" if what == "types" else "string")
    def scan(texts: pd.Series, known: pd.Series) -> pd.Series:
        finder = _finder(shared)
        out: list = []
        seen: dict = {}
        for t, k in zip(texts, known, strict=True):
            if not t:
                out.append(t if what != "types" else None)
                continue
            if t not in seen:
                spans = finder.spans(t, None if k is None else set(k))
                seen[t] = sorted({kind for _, _, kind in spans}) if what == "types" else redact(t, spans)
            out.append(seen[t])
        return pd.Series(out, dtype=object)

    if small:
        return rows.withColumn("_out", scan(F.col("_t"), F.lit(None).cast("array<string>")))
    # a registry that is too large to broadcast: the distinct words of the texts are joined with its parts
    rows = rows.withColumn("_h", F.sha2("_t", 256))
    words = rows.select("_h", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower("_t"), "['’]s(?![a-z])", " "), F.lit(r"(?U)" + _PART), 1))).alias("w")).distinct()
    known = _name_words(_registered(members), words.select("w").distinct())
    held = words.join(known, "w").groupBy("_h").agg(F.collect_set("w").alias("_known"))  # the words of one text
    rows = rows.join(held, "_h", "left")
    return rows.withColumn("_out", scan(F.col("_t"), F.col("_known")))


_FINDERS: dict[int, Finder] = {}


def _finder(shared) -> Finder:
    """One automaton for each Python worker and registry."""
    value = shared.value
    if id(value) not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[id(value)] = Finder(*value)
    return _FINDERS[id(value)]


def personal_items(texts: DataFrame, table_name: str, record_id: str, text: Column, members: DataFrame) -> DataFrame:
    """(table_name, record_id, pii_type), one row for each type that a record's text holds."""
    rows = texts.select(F.col(record_id).cast("string").alias("record_id"), text.alias("_t")).where("length(trim(_t)) > 0")
    return _scan(rows, members, "types").select(F.lit(table_name).alias("table_name"), "record_id", F.explode("_out").alias("pii_type")).distinct()


def redacted(texts: DataFrame, table_name: str, record_id: str, text: Column, members: DataFrame) -> DataFrame:
    """(table_name, record_id, redacted): each row's text with its items replaced by placeholders."""
    rows = texts.select(F.col(record_id).cast("string").alias("record_id"), text.alias("_t"))
    return _scan(rows, members, "text").select(F.lit(table_name).alias("table_name"), "record_id", F.col("_out").alias("redacted"))
