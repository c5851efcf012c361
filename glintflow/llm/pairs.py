"""Broken prompt and response pairs, each with its defect.

Responses are split into sentences, identifiers and code masked, and the distinct ones of all responses (their openings, and
what follows them) are clustered by MinHash: bands of a signature over their five-word shingles propose neighbours, each that would join
two clusters is verified by the Jaccard similarity of the shingles (``SIMILAR``), and verified links are contracted to clusters. For each
cluster the whole corpus tells over how many unrelated prompts it recurs and how often a solution (code, or another sentence that names an
identifier) comes with it. A template that recurs over ``RECURS`` prompts, with a solution in at most ``SOLVED`` of its places, is one of
refusals, whatever its words and language. If it names an identifier itself, it must also mostly come with a
recurring sentence that names none and has no solution in half of its places, as a recurring short repair does not; it is no solution then.
An answer without a solution that consists of such templates by half of its words or more is a refusal. Phrases that decline break ties
only: where a sentence recurs too seldom for the corpus to tell, or templates are less than half of the answer. A template that
solutions come with is none, whatever it says. Copies, other languages and broken ends are told from each pair alone.

Order of defects where several would apply: empty, refusal, copies_prompt, wrong_language, truncated.

Defined results
---------------
* The answer is the completion, else the content of the last message of the assistant; the prompt likewise, of the user's last message before it.
* A null or absent answer is empty. Without a prompt nothing is copied and no language is wrong.
* Pairs that are sound have no row. Repeated pairs have a row for each id; null ids are passed over.
* Sentences of fewer than five words are one shingle. Ties between templates of a cluster go to the smallest text.
* Texts are used whole, all sentences of all answers are counted. Extra columns are ignored.
* An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintflow.operators.training import pairs

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
PAIRED = 1000  # openings in a block of a bucket
RECURS = 4  # distinct prompts from which on a template counts as recurring
SOLVED = 0.05  # share of places with a solution up to which a recurring template is one of refusals
COVERED = 0.5  # share of an answer's words that such templates make up in a refusal

_FENCE = re.compile(r"```[ \t]*([\w+#.-]*)[ \t]*\n?(.*?)(?:```|\Z)", re.S)
_TICKS = re.compile(r"`[^`\n]*`")
_BLANK = r"[\s​-‏⁠﻿­ ]"
_LABEL = re.compile(rf"^{_BLANK}*(?:[*_#>]*{_BLANK}*(?:answer|response|fix|solution|output|result|reply|assistant|antwort|réponse|respuesta|lösung|solución|a)[*_]*{_BLANK}*[:：][*_]*{_BLANK}*)+", re.I)
_FILLERS = {"", "na", "none", "null", "nil", "todo", "tbd", "fixme", "answer", "response", "fix", "solution", "output", "placeholder", "empty", "noanswer", "noresponse", "nooutput", "tobedone", "pending", "xxx", "insertanswerhere", "youranswerhere", "keine", "aucune", "ninguna"}  # fixed values
_STRONG = re.compile(
    r"\b(?:i|we)\b[^.!?]{0,30}\b(?:can['’]?t|cannot|can not|won['’]?t|will not|unable|not able|not allowed|not permitted|decline|refuse)\b[^.!?]{0,30}\b(?:help|assist|answer|do|comply|provide|work|change|support|fulfil+|discuss|continue|process|with|that|this)\b"
    r"|\b(?:i|we)\b[^.!?]{0,20}\b(?:must|have to|need to) (?:decline|refuse)\b|\b(?:i|we)(?: would|['’]d) (?:rather|prefer) not\b|\bnot (?:feel )?comfortable\b|\bdon['’]?t feel comfortable\b"
    r"|\b(?:guidelines?|polic(?:y|ies)|rules?)\b[^.!?]{0,40}\b(?:not (?:allow|permit)|forbid|prohibit)|\bagainst (?:the|my|our)\b[^.!?]{0,30}\b(?:rules|polic(?:y|ies)|guidelines?)\b"
    r"|\bnot be appropriate (?:for me|to)\b|\bbeyond what i (?:may|can|am)\b|\bno answer can be given\b|\bas an? (?:automated|ai|artificial|language|virtual)\b[^.!?]{0,60}\bnot\b"
    r"|\bich kann\b[^.!?]{0,60}\bnicht (?:helfen|beantworten|weiterhelfen)\b|\bje ne (?:peux|puis) pas\b[^.!?]{0,30}\b(?:aider|répondre)\b|\bno puedo\b[^.!?]{0,30}\b(?:ayudar|responder)\b|\bnão posso\b[^.!?]{0,30}\b(?:ajudar|responder)\b",
    re.I,
)

# fixed values: frequent words of each language
_WORDS = {
    "en": "the of and to is it that in for with you this are be not can when which from if as by an was has do your what why how i so or on before because here runs really",
    "de": "der die das und ist nicht ein eine zu den mit von auf für wird dem im sich auch werden wenn diese oder nach über so vor warum wie muss kann hier weil den code ich meldet wert",
    "fr": "le la les des et est une du que pour dans pas ce sur qui avec il au par ne cette ou plus votre sont être l d comment pourquoi avant donc faut peut ici parce ligne valeur",
    "es": "el los las y es una del que para se por con no lo al como su este esta más ya si cuando o antes así hay este porque qué cómo valor línea nunca puede aquí tiene",
    "pt": "o os as e é uma do da que para em se por com não ao como seu este esta mais já dos das no na quando ou um pode aqui porque valor linha nunca precisa deste antes foi seja ser isso tem você",
    "it": "il gli e è una del della che per si con non al come questo questa più i di un da sono nel ma perché qui valore prima deve può riga lo viene",
    "nl": "de het een en van niet dat te op met voor zijn die er aan ook als wordt bij naar deze om omdat hier waarde regel moet kan",
    "sv": "och att det är en ett som på av inte den med för till har om kan ska från eller när här måste innan raden värdet",
    "da": "og at det er en et som på af ikke den med til har kan skal fra eller når her må før linjen værdien være",
    "pl": "nie jest się na że jak dla przez tak co lub przed po ale tego musi może wartość linia tutaj być ponieważ",
    "cs": "je se na že jak pro tak co nebo před po ale musí může hodnota řádek zde být protože není který",
    "tr": "ve bir bu için ile değil olarak daha çok gibi var yok önce sonra ama çünkü değer satır burada olmalı",
    "ro": "și este în cu pe nu din care pentru sau mai fi trebuie înainte dar aici valoarea linia poate sunt",
    "fi": "ja on ei se että joka kun mutta tai ennen täällä arvo rivi pitää voi koska tämä ole",
    "hu": "és az nem hogy egy ez van meg kell csak vagy mert itt előtt érték sor lehet",
}
# letters of each script; other letters are Latin
_SCRIPTS = {
    "cyrillic": r"[\u0400-\u052f]", "greek": r"[\u0370-\u03ff\u1f00-\u1fff]", "hebrew": r"[\u0590-\u05ff]", "arabic": r"[\u0600-\u06ff\u0750-\u077f]", "indic": r"[\u0900-\u0dff]",
    "thai": r"[\u0e00-\u0e7f]", "hangul": r"[\u1100-\u11ff\uac00-\ud7af]", "kana": r"[\u3040-\u30ff]", "han": r"[\u3400-\u4dbf\u4e00-\u9fff]",
}
_SCRIPTS = {k: re.compile(v) for k, v in _SCRIPTS.items()}
_NOT_LATIN = re.compile(r"[\u0370-\u052f\u0590-\u06ff\u0750-\u077f\u0900-\u0e7f\u1100-\u11ff\u1f00-\u1fff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")
_LANGUAGES_OF: dict[str, list[str]] = {}
for _k, _v in _WORDS.items():
    for _w in set(_v.split()):
        _LANGUAGES_OF.setdefault(_w, []).append(_k)
_ASKED = {
    "de": r"german|deutsch|allemand|alemán|alemão", "fr": r"french|français|französisch|francés", "es": r"spanish|español|spanisch|espagnol", "pt": r"portuguese|português|portugiesisch|portugais|portugués",
    "it": r"italian|italiano|italienisch|italien", "nl": r"dutch|nederlands|niederländisch|néerlandais", "en": r"english|englisch|anglais|inglés|inglês",
    "sv": r"swedish|svenska", "da": r"danish|norwegian|dansk|norsk", "pl": r"polish|polski", "cs": r"czech|čeština", "tr": r"turkish|türkçe", "ro": r"romanian|română", "fi": r"finnish|suomi", "hu": r"hungarian|magyar",
    "cyrillic": r"russian|ukrainian|bulgarian|serbian|cyrillic", "greek": r"greek", "hebrew": r"hebrew", "arabic": r"arabic|persian|farsi|urdu", "indic": r"hindi|bengali|tamil|telugu|marathi|sanskrit", "thai": r"thai", "hangul": r"korean", "kana": r"japanese",
    "han": r"chinese|mandarin|japanese",
}
_ASKS = {k: re.compile(rf"\b(?:in|auf|en|em|into|to|ins|au|al)\s+(?:{v})\b|\b(?:{v})\s+(?:answer|response|reply|translation|please)\b", re.I) for k, v in _ASKED.items()}


_WORD = re.compile(r"[^\W\d_]+")


def votes(text: str) -> dict[str, int]:
    """How many of the text's words are frequent words of each language."""
    out = dict.fromkeys(_WORDS, 0)
    for w in _WORD.findall(text.lower()):
        for k in _LANGUAGES_OF.get(w, ()):
            out[k] += 1
    return out


def script(text: str) -> str:
    """The script other than Latin that most letters have; '' if most are Latin or there are fewer than four."""
    if len(_NOT_LATIN.findall(text)) < 4:
        return ""
    n = {k: len(r.findall(text)) for k, r in _SCRIPTS.items()}
    if n["kana"]:
        n["kana"] += n.pop("han")
    best = max(n, key=lambda k: n[k])
    return best if 2 * n[best] > sum(map(len, _WORD.findall(text))) else ""


def language(text: str) -> str:
    """The script if it isn't Latin, else the language with the most frequent words; '' if too few."""
    if known := script(text):
        return known
    v = votes(text)
    best = max(v, key=lambda k: v[k])
    return best if v[best] >= 3 else ""


def foreign(prompt: str, answer: str, asked: str) -> bool:
    """Whether the answer's prose is in another language than the prompt's (its own words) and than those that it asks for anywhere (asked: its whole prose)."""
    theirs = language(prompt)
    if not theirs:
        return False
    mine, v = script(answer), votes(answer)
    if mine == theirs or not mine and max(v.values()) < max(2, 1.5 * v.get(theirs, 0)):
        return False
    wanted = {k for k, r in _ASKS.items() if r.search(asked)}
    if mine:
        return mine not in wanted
    own = max((v[k] for k in v if k == theirs or k in wanted), default=0)
    said = "\n".join(x for x in answer.split("\n") if not _CODE_LINE.match(x))
    v = votes(said)
    most = max(v.values())
    if most >= 3 and most >= 1.5 * own:
        return True
    # few words: two different ones, and none of the prompt's language
    return not own and theirs in v and max(votes(" ".join(set(_WORD.findall(said.lower())))).values()) >= 2


def prose(text: str) -> str:
    """The text without code."""
    return _TICKS.sub(" ", _FENCE.sub(" ", text) if "```" in text else text)


_QUOTED = re.compile(r"\s*(?:[-*]\s*\[|(?:language|file|diagnostics|code)\s*:)", re.I)
_MESSAGE = re.compile(r"\bthe message is:", re.I)


def prompt_prose(prompt: str) -> str:
    """What the asker wrote: without code and without quoted diagnostics and file headers."""
    kept = [line for line in prose(prompt).split("\n") if not _QUOTED.match(line)]
    return _MESSAGE.split("\n".join(kept))[0]


_LINE_MARK = re.compile(r"(?m)^[ \t]*(?:[>|]+|//|#+(?= )|\*(?= )|\d+[.)](?= ))[ \t]*")
_FENCE_MARK = re.compile(r"```[\w+#.-]*")
_ZERO_WIDTH = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD])


def unlabelled(text: str) -> str:
    """The text after a label such as ``Answer:``."""
    m = _LABEL.match(text)
    return text[m.end() :] if m else text


def squeezed(text: str) -> str:
    """Lower-cased text without white space, quote marks at line starts, fences and emphasis."""
    t = unlabelled(text).strip()
    if len(t) > 1 and t[0] + t[-1] in ('""', "''", "“”", "„“", "«»", "‘’"):
        t = t[1:-1]  # the whole in quotes
    t = _LINE_MARK.sub("", t)
    if "```" in t:
        t = _FENCE_MARK.sub("", t)
    t = "".join(t.replace("**", "").replace("`", "").split())  # quotes and operators stay: they may be what was mended
    return (t if t.isascii() else t.translate(_ZERO_WIDTH)).lower()


_OPEN, _CLOSE = "([{", ")]}"


def balanced(code: str) -> bool:
    """Whether all brackets of the code are closed; strings are passed over."""
    stack = 0
    plain = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){0,40}'", "", code)
    for c in plain:
        if c in _OPEN:
            stack += 1
        elif c in _CLOSE:
            stack -= 1
    return stack <= 0


_CODE_LINE = re.compile(r"^\s*(?:[\w.*&]+(?:\[[^\]]*\])?\s*(?::=|[-+*/]?=(?!=))|(?:pub|fn|func|def|class|impl|export|async|function|if|for|while|return|let|const|var|private|public|self\.|this\.|s\.|[})\]])\b|[})\];]|.*[;{]\s*$)")


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?。])[\"')\]]*\s+|\n+", text) if s.strip()]


def truncated(prompt: str, answer: str) -> bool:
    """Whether the answer stops inside a sentence or code."""
    a = re.sub(rf"{_BLANK}+\Z", "", answer)
    if a.count("```") % 2:
        return True
    blocks = list(_FENCE.finditer(a))
    asked = _FENCE.search(prompt or "")
    if blocks:
        last = blocks[-1]
        code = last[2]
        if a.endswith("```"):
            return _broken_code(code, asked[2] if asked else None)
    lines = [x for x in a.split("\n") if x.strip()]
    end = lines[-1].strip()
    if not blocks and len(lines) > 1 and (_CODE_LINE.match(lines[-1]) or lines[-1][:1] in " \t") and not re.match(r"\s*[-*•]\s", lines[-1]):
        start = next((i for i, x in enumerate(lines) if _CODE_LINE.match(x)), 0)
        return _broken_code("\n".join(lines[start:]), asked[2] if asked else None)
    if re.search(r"(?:\.\.\.|…|[,;:–—(/\-])$", end) and not end.endswith("```"):
        return True
    if re.match(r"(?:[-*•]|\d+[.)])\s+\S", end):
        return end.count("`") % 2 == 1 or bool(re.search(r"\b(?:the|a|an|of|to|and|or|der|die|das|le|la|el|de)$", end))
    if not blocks and len(lines) == 1 and not re.search(r"\s", end.strip("`")):
        return False  # a single word or expression
    return not re.search(r"[.!?。:;)\]}>`\"'”»]$", end) or end.endswith("`") and end.count("`") % 2 == 1


def _broken_code(code: str, asked: str | None) -> bool:
    if not balanced(code):
        return True
    mine = [x.rstrip() for x in code.strip("\n").split("\n") if x.strip()]
    if not mine:
        return False
    if asked:
        theirs = [x.rstrip() for x in asked.strip("\n").split("\n") if x.strip()]
        # the same code up to a point at which a line is cut
        if len(mine) < len(theirs) and mine[0] == theirs[0]:
            return True
        if len(mine) == len(theirs) and mine[-1] != theirs[-1] and theirs[-1].startswith(mine[-1]):
            return True
    return bool(re.search(r"(?:[=+*/,(&|]|\b(?:return|if|in|for|def|func|let|const)|\.)$", mine[-1].strip())) and not re.search(r"\breturn$", mine[-1].strip()) or mine[-1].strip().endswith(":")


_LETTERS = re.compile(r"[^\W_]+")
_HOLDERS = re.compile(rf"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)|{_BLANK}")
_DIGITS = re.compile(r"\d+")
_LONGEST = max(map(len, _FILLERS))


def filler(text: str) -> bool:
    """Whether letters and digits of the text are nothing or a filler."""
    held = ""
    for m in _LETTERS.finditer(text):
        held += m[0]
        if len(held) > _LONGEST:
            return False
    return held.lower() in _FILLERS


def judged(prompt: str | None, answer: str | None) -> tuple[str | None, list[str], bool]:
    """(defect told from the pair alone, distinct masked sentences, whether code is given)."""
    if answer is None:
        return "empty", [], False
    bare = unlabelled(answer)
    if filler(_FENCE_MARK.sub("", bare)) or len(bare) < 60 and _HOLDERS.sub("", bare) == "":
        return "empty", [], False
    fences = list(_FENCE.finditer(bare)) if "```" in bare else []
    said = prose(bare)
    units = sentences(_TICKS.sub("\x01", _FENCE.sub("\n", bare) if fences else bare))
    masked = [_DIGITS.sub("0", " ".join(u.split()).lower()).replace("\x01", "`x`") for u in units]
    code = any(m[2].strip() for m in fences) or sum(bool(_CODE_LINE.match(x)) for x in bare.split("\n")) >= 2
    defect = None
    if prompt:
        a, p = squeezed(answer), squeezed(prompt)
        asked = "".join(squeezed(m[2]) for m in _FENCE.finditer(prompt)) if "```" in prompt else ""
        written = prompt_prose(prompt)
        head = squeezed(written)
        if a and (a == p or a == asked or (asked and a == head) or len(a) >= 20 and (a in p and len(a) >= 0.5 * len(p) or a.strip(".") == p.strip(".") or a == head or a == head + asked)):
            defect = "copies_prompt"
        elif foreign(written, said, prose(prompt)):
            defect = "wrong_language"
    if defect is None and truncated(prompt or "", answer):
        defect = "truncated"
    return defect, list(dict.fromkeys(masked)), code


_JUDGED = T.StructType([T.StructField("defect", T.StringType()), T.StructField("openings", T.ArrayType(T.StringType())), T.StructField("code", T.BooleanType())])


@F.pandas_udf(_JUDGED)
def _judge(prompts: pd.Series, answers: pd.Series) -> pd.DataFrame:
    rows = [judged(p, a) for p, a in zip(prompts, answers, strict=True)]
    return pd.DataFrame(rows, columns=["defect", "openings", "code"])


def shingles(text: Column) -> Column:
    """The distinct runs of five words; a shorter text is one."""
    words = F.split(text, " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.array_distinct(runs)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(texts: pd.Series) -> pd.Series:
    """A key for each band of the MinHash signature of a list of shingles."""
    import numpy as np
    import xxhash

    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    out = []
    for runs in texts:
        h = np.array([xxhash.xxh64_intdigest(r) for r in runs], np.uint64)
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(h), 4096):
            low = np.minimum(low, (h[k : k + 4096, None] * a + b >> np.uint64(7)).min(0))
        out.append([np.int64(xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - (1 << 63)) for i in range(BANDS)])
    return pd.Series(out)


def clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): distinct openings and the smallest opening of their cluster."""
    named = openings.select("opening", F.xxhash64("opening").alias("id"))
    held = named.join(_labels(named), "id", "left").select("opening", F.coalesce("label", "id").alias("label"))
    return held.join(held.groupBy("label").agg(F.min("opening").alias("cluster")), "label").select("opening", "cluster")


def _labels(openings: DataFrame) -> DataFrame:
    """(id, label) of those of (id, opening) that are similar to others: one label for each cluster. Ids are 64-bit digests of openings.

    The smallest and the largest id of a bucket are verified with all others, which joins most; then all pairs of a bucket
    that are still in different clusters are, in blocks of ``PAIRED``, so that no pair of a bucket whose link matters is passed over.
    """
    from glintflow.session import checkpointed

    keyed = checkpointed(openings.select("id", F.posexplode(_bands(shingles(F.col("opening")))).alias("band", "key")))
    buckets = keyed.groupBy("band", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    near = keyed.join(buckets, ["band", "key"]).select("id", F.explode(F.array("lo", "hi")).alias("centre")).where("id <> centre").distinct()
    links = checkpointed(_verified(near, openings))
    label = _contracted(links)
    held = keyed.join(buckets.where("size > 2").select("band", "key", "size"), ["band", "key"]).join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    torn = held.groupBy("band", "key").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("band", "key")
    held = held.join(torn, ["band", "key"]).withColumn("blocks", F.ceil(F.col("size") / PAIRED).cast("int"))
    held = checkpointed(held.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    if held.limit(1).count():
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        mine = held.select("band", "key", "id", "label", F.col("block").alias("i"), every.alias("j"))
        theirs = held.select("band", "key", F.col("id").alias("centre"), F.col("label").alias("other"), every.alias("i"), F.col("block").alias("j"))
        rest = mine.join(theirs, ["band", "key", "i", "j"]).where("id < centre AND label <> other").select("id", "centre").distinct()
        label = _contracted(checkpointed(links.unionByName(_verified(rest, openings))))
    return label


def _verified(near: DataFrame, openings: DataFrame) -> DataFrame:
    """The pairs (id, centre) whose openings are similar, in both directions."""
    mine, theirs = shingles(F.col("opening")), shingles(F.col("other"))
    both = near.join(openings.select("id", "opening"), "id").join(openings.select(F.col("id").alias("centre"), F.col("opening").alias("other")), "centre")
    links = both.where(F.size(F.array_intersect(mine, theirs)) >= SIMILAR * F.size(F.array_union(mine, theirs))).select("id", "centre")
    return links.unionByName(links.select(F.col("centre").alias("id"), F.col("id").alias("centre"))).distinct()


def _contracted(links: DataFrame) -> DataFrame:
    """(id, label): each linked id and the smallest id that links lead to."""
    from glintflow.session import checkpointed

    label = checkpointed(links.groupBy("id").agg(F.least(F.col("id"), F.min("centre")).alias("label")))
    while True:  # the smallest label of the neighbours, then of the label itself, until nothing changes
        seen = links.join(label.withColumnRenamed("id", "centre"), "centre").groupBy("id").agg(F.min("label").alias("c"))
        step = label.join(seen, "id").select("id", F.least("label", "c").alias("next"), F.col("label").alias("was"))
        jump = step.join(label.select(F.col("id").alias("next"), F.col("label").alias("further")), "next", "left")
        new = checkpointed(jump.select("id", F.least("next", F.coalesce("further", "next")).alias("label"), "was"))
        label = new.select("id", "label")
        if new.where("label <> was").limit(1).count() == 0:
            return label


def templates(read: DataFrame) -> DataFrame:
    """(id, label, names, recurs, n, solved, coded, declines): the figures of the cluster (label) of each sentence that recurs or declines.

    names: whether it names an identifier. n, solved and coded: the cluster's places, and those with a solution beside it and with code.
    recurs: whether it stands under ``RECURS`` distinct prompts or more. declines: whether the sentence says so in plain words.
    A cluster's prompts are those of all its members: of each opening the ``RECURS`` smallest prompt keys are carried to it, which tell
    whether there are so many.
    """
    from glintflow.session import checkpointed

    each = read.select(F.explode("r.openings").alias("opening"), F.coalesce("prompt_key", F.lit(0)).alias("prompt_key"), F.col("r.code").alias("code"), "ticks")
    each = each.select("opening", "prompt_key", F.col("code").cast("int").alias("coded"), (F.col("code") | (F.col("ticks") > F.when(_names("opening"), 1).otherwise(0))).cast("int").alias("solved"))
    by_prompt = each.groupBy("opening", "prompt_key").agg(F.count(F.lit(1)).alias("n"), F.sum("solved").alias("solved"), F.sum("coded").alias("coded"))
    by_prompt = checkpointed(by_prompt.withColumn("id", F.xxhash64("opening")))
    named = checkpointed(by_prompt.groupBy("id", "opening").agg(F.sum("n").alias("n"), F.sum("solved").alias("solved"), F.sum("coded").alias("coded")))
    member = checkpointed(named.join(_labels(named.select("id", "opening")), "id", "left").withColumn("label", F.coalesce("label", "id")))
    figures = member.groupBy("label").agg(F.sum("n").alias("n"), F.sum("solved").alias("solved"), F.sum("coded").alias("coded"))
    first = by_prompt.select("id", "prompt_key", F.row_number().over(Window.partitionBy("id").orderBy("prompt_key")).alias("k")).where(F.col("k") <= RECURS)  # Spark limits each group before the shuffle
    prompts = first.join(member.select("id", "label"), "id").select("label", "prompt_key").distinct().groupBy("label").agg((F.count(F.lit(1)) >= RECURS).alias("recurs"))
    told = member.select("id", "opening", "label", _names("opening").alias("names")).join(figures, "label").join(prompts, "label")
    return told.withColumn("declines", _declines("opening")).drop("opening").where("recurs OR declines")


def _names(opening: str) -> Column:
    return F.col(opening).contains("`x`")


@F.pandas_udf(T.BooleanType())
def _declines(texts: pd.Series) -> pd.Series:
    return pd.Series([bool(_STRONG.search(t)) for t in texts], dtype=bool)


def refusals(read: DataFrame) -> DataFrame:
    """(example_id) of the answers that decline and give no solution."""
    from glintflow.session import checkpointed

    words = lambda o: F.size(F.split(o, " "))
    open_ = read.where("NOT r.code AND (r.defect IS NULL OR r.defect <> 'empty')").withColumn("k", F.monotonically_increasing_id())  # of a checkpoint: the same whenever it is read
    open_ = open_.select("example_id", "k", "ticks", "r.openings", F.aggregate("r.openings", F.lit(0), lambda a, o: a + words(o)).alias("words"))
    said = open_.select("example_id", "k", "ticks", F.col("words").alias("whole"), F.explode("openings").alias("o")).select("example_id", "k", "ticks", "whole", F.xxhash64("o").alias("id"), words(F.col("o")).alias("words"))
    few = lambda c: F.col(c) <= SOLVED * F.col("n")
    known = templates(read).select("id", "label", "names", "recurs", "n", "solved", (F.col("declines") & (F.col("solved") <= 0.5 * F.col("n"))).alias("declines"), (~F.col("names") & F.col("recurs") & few("coded") & (F.col("solved") <= 0.5 * F.col("n"))).alias("beside"), (F.col("names") & F.col("recurs") & few("solved")).alias("alone"))
    told = checkpointed(said.join(known, "id"))
    # templates that name an identifier: what mostly stands beside them
    beside = told.groupBy("k").agg(F.bool_or("beside").alias("beside"), F.bool_or("alone").alias("alone")).where("alone").drop("alone")
    shy = told.where("alone").drop("beside").join(beside, "k").groupBy("label").agg((2 * F.count_if("beside") >= F.count(F.lit(1))).alias("shy")).where("shy")
    told = told.join(shy, "label", "left").withColumn("shy", F.coalesce("shy", F.col("names") & F.col("declines") & ~F.col("recurs")))
    # answers that name identifiers in such templates only have no solution
    unsolved = told.groupBy("k").agg(F.count_if("shy").alias("shies"), F.max("ticks").alias("ticks")).where("shies >= ticks").select("k", (F.col("ticks") > 0).alias("shied"))
    told = checkpointed(told.join(unsolved, "k"))
    fewer = told.where("shied AND NOT names").groupBy("label").agg(F.count(F.lit(1)).alias("fewer"))
    told = told.join(fewer, "label", "left").withColumn("solved", F.col("solved") - F.coalesce("fewer", F.lit(0)))
    of_template = F.col("recurs") & F.when(F.col("names"), F.col("shy")).otherwise(few("solved"))
    out = told.groupBy("k", "example_id", "whole").agg(F.sum(F.when(of_template, F.col("words")).otherwise(0)).alias("covered"), F.bool_or("declines").alias("declines"))
    return out.where(F.col("declines") | (F.col("covered") > 0) & (F.col("covered") >= COVERED * F.col("whole"))).select("example_id").distinct()


def defects(examples: DataFrame) -> DataFrame:
    """(example_id, defect) of each defective pair."""
    from glintflow.session import checkpointed

    ticks = F.size(F.filter("r.openings", lambda o: o.contains("`x`")))
    read = checkpointed(pairs(examples).select("example_id", F.xxhash64("prompt").alias("prompt_key"), _judge("prompt", "answer").alias("r")).withColumn("ticks", ticks))
    out = read.join(refusals(read).withColumn("refused", F.lit(True)), "example_id", "left")
    return out.select("example_id", F.when(F.col("refused"), "refusal").otherwise(F.col("r.defect")).alias("defect")).where("defect IS NOT NULL")
