import pytest

from glintflow.llm import pairs

ASK = "Repair the function so that the analyzer accepts it.\n```go\nfunc f(a []int) int {\n\ts := 0\n\tfor _, v := range a {\n\t\ts = s + \"v\"\n\t}\n\treturn s\n}\n```"
CODE = "```go\nfunc f(a []int) int {\n\ts := 0\n\tfor _, v := range a {\n\t\ts = s + v\n\t}\n\treturn s\n}\n```"
DE = "Die Schleife in `f` ändert `a` nie, deshalb meldet der Prüfer den Fehler. Der Wert von `a` kann fehlen und muss vorher geprüft werden."
CASES = [
    (ASK, None, "empty"), (ASK, "", "empty"), (ASK, " ​\n", "empty"), (ASK, "N/A", "empty"), (ASK, "Fix: \n\n```\n\n```", "empty"), (ASK, "<answer>", "empty"), (ASK, "...", "empty"), (ASK, "Answer: -", "empty"),
    (ASK, ASK, "copies_prompt"), (ASK, ASK.upper(), "copies_prompt"), (ASK, "> " + ASK.replace("\n", "\n> "), "copies_prompt"), (ASK, "Answer: " + " ".join(ASK.split()), "copies_prompt"), (ASK, ASK.split("it.\n")[1], "copies_prompt"),
    (ASK, DE, "wrong_language"), (ASK + "\nPlease answer in German.", DE, None), (DE + " Warum ist das so und wie behebe ich das?", DE + " Nach dieser Änderung verschwindet die Meldung.", None),
    (ASK, "The loop in `f` never updates `a`, so the", "truncated"), (ASK, "The loop in `f` never upd…", "truncated"), (ASK, "The loop in `f` never updates the value -", "truncated"), (ASK, CODE[:-12], "truncated"), (ASK, CODE[:60] + "\n```", "truncated"),
    (ASK, CODE, None), (ASK, CODE.replace("```go\n", "").replace("\n```", ""), None), (ASK, "The call fails because `a` has type `b` here.\n- run the checker again\n- commit `f`", None), (ASK, "Repair the function so that the analyzer accepts it.\n\nThe loop in `f` never updates `a`, so the checker reports it.", None),
    (ASK, "Unfortunately the message is misleading. Rename `a` or mark it as unused.", None), ("", "Some words without a question.", None), (None, "Some words without a question.", None),
]


@pytest.mark.parametrize("prompt, answer, want", CASES)
def test_told_from_the_pair(prompt, answer, want):
    assert pairs.judged(prompt, answer)[0] == want


X = "example_id bigint, format string, prompt string, completion string, messages array<struct<role:string,content:string>>, defect string"


def test_refusals_are_recurring_templates(spark):
    rows, want, n = [], {}, 0

    def add(answer, defect, prompt=None):
        nonlocal n
        n += 1
        rows.append((n, "jsonl", prompt or f"Why does `q{n}` fail here and what is to be done for it?", answer, None, "x"))
        if defect:
            want[n] = defect

    for k in range(6):
        add("That is nothing this service would ever wish to be asked about, sorry.", "refusal")  # by its figures: no cue of its own
        add("Hello! I cannot assist with this request. I hope you understand.", "refusal")
        add(f"I can't reproduce the second warning, but the first one is clear. Rename `q{k}` to fix it.", None)
        add("You are not allowed to move `x` here. Import `y` from the module.", None)
    add("I cannot help with that.", "refusal")  # once, by its words
    n += 1
    rows.append((n, "openai", None, None, [("system", "s"), ("user", "Why does it fail and what is to be done?"), ("assistant", "I cannot assist with this request.")], "x"))
    want[n] = "refusal"
    n += 1
    rows.append((n, "openai", None, None, [("user", "Why?")], None))
    want[n] = "empty"
    n += 1
    rows.append((n, "openai", None, None, None, None))
    want[n] = "empty"
    rows.append((None, "jsonl", "p", None, None, None))
    got = {r.example_id: r.defect for r in pairs.defects(spark.createDataFrame(rows, X)).collect()}
    assert got == want
    assert pairs.defects(spark.createDataFrame([], X)).count() == 0


def test_clusters_join_near_openings(spark):
    base = "this service is not able to answer any question about the file that you have sent to it because of rules that hold for all"
    texts = [base, base + " users", base + " people", "something else entirely that has nothing in common with it", "short"]
    got = {r.opening: r.cluster for r in pairs.clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert len({got[t] for t in texts[:3]}) == 1 and got[texts[3]] == texts[3] and got["short"] == "short"

ES = "Mueve la comprobación antes del retorno temprano en `f`."
RU = "Цикл не меняет значение, поэтому проверка сообщает об ошибке."


@pytest.mark.parametrize("prompt, answer, want", [
    (ASK, "Cambia la línea para que `a` se lea antes de `b`. " + ES, "wrong_language"), (ASK, "Fix: " + ES, "wrong_language"), (ASK + "\nAnswer in Spanish, please.", "Fix: " + ES, None),
    (ASK, RU, "wrong_language"), (ASK + "\nPlease answer in Russian.", RU, None), ("Почему программа не работает и что делать?", RU, None), (ASK, "このループは値を変更しないため、エラーになります。", "wrong_language"), (RU, DE, "wrong_language"),
    (ASK, "Pętla nie zmienia tego pola, więc przed użyciem musi być sprawdzona.", "wrong_language"), (ASK, "func (s *T) f() {\n\ts.del = s.en\n\ts.del()\n}", None), (ASK, "Check `a`.", None),
])
def test_language_against_that_of_the_prompt(prompt, answer, want):
    assert pairs.judged(prompt, answer)[0] == want


def test_templates_with_a_slot_recur_by_their_cluster(spark):
    said = "whatever the question about its content may have been, nothing is ever discussed by this service, and that will never change in any way for the file {}"
    rows = [(k, "jsonl", f"Why does `q{k}` fail here and what is to be done for it?", said.format(slot).capitalize() + ".", None, None) for k, slot in enumerate(["alpha", "beta", "gamma", "delta", "omega"])]
    rows += [(10 + k, "jsonl", "Why does it fail and what is to be done?", f"It is not clear to me which of the two you mean, and it would be good to know some more of it before going on with these {slot}.", None, None) for k, slot in enumerate(["files", "rows", "lines", "words", "terms"])]
    got = {r.example_id: r.defect for r in pairs.defects(spark.createDataFrame(rows, X)).collect()}
    assert got == dict.fromkeys(range(5), "refusal")  # the other template has one prompt


def test_clusters_verify_the_inner_pairs_of_a_bucket(spark, monkeypatch):
    stem = "this service keeps to its rules and so it will not go into any question about the file that was sent to it by you or by others today".split()
    odd = lambda first, last: " ".join([first, *stem[1:9], "x", *stem[10:20], last])
    texts = [" ".join(stem), " ".join([*stem, "indeed"]), "aaa " + " ".join(odd("a", "b").split()[:14]) + " q w e r t", "zzz " + " ".join(odd("a", "b").split()[4:14]) + " p o i u y"]
    one = pairs.F.udf(lambda _: [7], "array<bigint>")  # all in one bucket
    monkeypatch.setattr(pairs, "_bands", one)
    for block in (1000, 1):
        monkeypatch.setattr(pairs, "PAIRED", block)
        got = {r.opening: r.cluster for r in pairs.clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
        assert got == {texts[0]: texts[0], texts[1]: texts[0], texts[2]: texts[2], texts[3]: texts[3]}


def test_a_late_refusal_is_one(spark):
    said = "Hello there. You ask about a function. I see that the matter is pressing. I cannot help with that."
    row = lambda k, text: (k, "jsonl", "Why does it fail and what is to be done?", text, None, None)
    got = pairs.defects(spark.createDataFrame([row(1, said), row(2, said + " Rename `a` and run it again.")], X)).collect()
    assert [tuple(r) for r in got] == [(1, "refusal")]


def _asks(k):
    return f"Why does `q{k}` fail here and what is to be done for it?"


def test_figures_decide_without_phrases(spark, monkeypatch):
    never = pairs.F.udf(lambda _: False, "boolean")
    monkeypatch.setattr(pairs, "_declines", never)
    rows, want = [], {}
    say = lambda text, defect=None: (rows.append((len(rows), "jsonl", _asks(len(rows)), text, None, None)), defect and want.update({len(rows) - 1: defect}))
    for k in range(6):
        say("Zu dieser Anfrage wird hier grundsätzlich keine Auskunft erteilt. Danke.", "refusal")  # no word of it is listed anywhere
        say(f"Hello! I would rather talk about something else than `q{k}`. Danke.", "refusal")  # names an identifier, beside a sentence that names none
        say(f"Rename `q{k}` to fix it.")  # a recurring short repair stands alone
        say(f"Rename `q{k}` to fix it. Hello!")
        say("Run the checker again. Change `a` to `b`.")  # recurs beside a solution
        say(f"Hello! The loop number {k} of this file counts the rows of page {k} in vain, which nobody reads later on anyway.".replace("rows", "rows" + "abcdef"[k]))  # a greeting is less than half
    got = {r.example_id: r.defect for r in pairs.defects(spark.createDataFrame(rows, X)).collect()}
    assert {k: v for k, v in got.items() if v == "refusal"} == want


def test_clusters_find_all_similar_pairs(spark):
    """Recall of the links against exact Jaccard over all pairs of distinct sentences."""
    d = spark.read.parquet("/root/testdata/sf0.01/ml_training_examples.parquet")
    read = pairs.pairs(d).select(pairs._judge("prompt", "answer").alias("r")).select(pairs.F.explode("r.openings").alias("opening")).distinct()
    texts = [r.opening for r in read.collect()]
    texts += [f"{t} {w}" for t in texts if len(t.split()) > 12 for w in ("now", "then", "again")]  # near copies
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split(" ") for t in texts)]
    got = {r.opening: r.cluster for r in pairs.clusters(spark.createDataFrame([(t,) for t in set(texts)], "opening string")).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and texts[i] != texts[j]]
    found = sum(got[texts[i]] == got[texts[j]] for i, j in links)
    assert len(links) > 100 and found >= 0.9 * len(links), (found, len(links))
    print("links found", found, "of", len(links))


def test_a_language_asked_for_after_the_message():
    asked = "Repair the function so that the analyzer accepts it. The message is: unused variable: `x`\nPlease answer in {}."
    es = "Fix: Cambia la línea para que `a` se lea antes de `b`. El valor de `c` puede faltar, así que hay que comprobarlo. " + ES
    assert pairs.judged(asked.format("Spanish"), es)[0] is None and pairs.judged(asked.format("French"), es)[0] == "wrong_language"


def test_one_bucket_of_several_clusters(spark, monkeypatch):
    """The ends of a bucket join two clusters, all others are joined by the pairs inside."""
    texts = [" ".join([*(f"w{c}x{k}" for k in range(24)), *tail]) for c in range(6) for tail in ([], ["again"], ["again", "now"])]
    monkeypatch.setattr(pairs, "_bands", pairs.F.udf(lambda _: [7], "array<bigint>"))
    for block in (1000, 4):
        monkeypatch.setattr(pairs, "PAIRED", block)
        got = {r.opening: r.cluster for r in pairs.clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
        assert got == {t: texts[i - i % 3] for i, t in enumerate(texts)}


def test_a_copy_in_one_line_with_words_after_its_code():
    asked = ASK + "\nPlease answer in German."
    assert pairs.judged(asked, " ".join(asked.split()))[0] == "copies_prompt"
