import numpy as np

from glintflow.llm import bytetext, reading


def test_held_out_accuracy(spark):
    """Four fifths of the labelled documents fit, one fifth is predicted."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/reading_labels.parquet").toPandas().groupby("doc_id")["level"].agg(["median", "min", "max", "count"])
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").loc[labels.index]
    words = [np.unique(h) for h in bytetext.hashed([t or "" for t in docs["text"]])]
    level = np.floor(labels["median"].to_numpy() + 0.5).astype(int)
    order = np.random.default_rng(0).permutation(len(words))
    held, used = order[: len(order) // 5], sorted(order[len(order) // 5 :], key=lambda i: (level[i], words[i].tobytes()))
    m = reading.Model([words[i] for i in used], level[used])
    got = m.predict(*reading._flat([words[i] for i in held]))
    agreed = ((labels["min"] == labels["max"]) & (labels["count"] > 1)).to_numpy()[held]
    assert (np.abs(got - level[held]) <= 1).all() and (got == level[held]).mean() > 0.75 and (got == level[held])[agreed].mean() >= 0.9


EASY, HARD = "the tool finds the bug and you can fix it now in the box of the page", "notwithstanding the impredicative formalism of the compositionality that is presupposed"


def test_rows(spark):
    long = lambda t, n=4: " ".join([t] * n)
    docs = spark.createDataFrame(
        [(1, long(EASY), "guide", "fr"), (2, long(HARD, 6), None, "x"), (3, long(EASY), "log", "en"), (4, EASY, "guide", "en"), (5, None, "faq", "en"), (6, "", "faq", "en"), (7, long("der die das und ist nicht ein eine zu den mit", 6), "faq", "en"), (8, long(EASY, 5000), "chat", "en"), (8, long(EASY, 5000), "chat", "en")]
        + [(100 + i, long(EASY if i % 2 else HARD, 6) + f" n{i}", "faq", "en") for i in range(40)],
        "doc_id bigint, text string, doc_type string, level string",
    )
    labels = spark.createDataFrame([(100 + i, "r", 1 if i % 2 else 5) for i in range(40)] + [(101, "q", 1), (102, "q", 9), (103, "q", None), (None, "q", 2), (999, "q", 2)], "doc_id bigint, rater string, level int")
    got = sorted((r.doc_id, r.level) for r in reading.levels(docs, labels).collect() if r.doc_id < 100)
    assert got == [(1, 1), (2, 5), (8, 1), (8, 1)]
    assert reading.levels(docs, labels.limit(0)).count() == 0 == reading.levels(docs.limit(0), labels).count()


OTHERS = [
    "Tämä ohje kertoo miten tarkistin ajetaan ennen kuin muutos viedään haaraan ja mitä sen jälkeen pitää tehdä for sivulla mainittu asetus ei ole pakollinen mutta se auttaa kun virheitä on paljon ja niiden syitä etsitään rivi kerrallaan tiedosto kerrallaan moduuli kerrallaan koko projektista yhdessä toisten kanssa",
    "Ten dokument opisuje jak uruchomić narzędzie przed scaleniem zmian oraz co zrobić gdy pojawi się błąd to jest ważne ponieważ raport zawiera wszystkie ostrzeżenia z ostatniego tygodnia a niektóre z nich dotyczą plików które zostały już usunięte z repozytorium przez innego członka zespołu dawno temu bez żadnej informacji",
    "Den här texten beskriver hur verktyget körs innan en ändring slås ihop och vad man gör när ett fel uppstår for det mesta räcker det att läsa rapporten rad för rad och rätta det första felet eftersom många av de andra bara är följder av det och försvinner av sig själva efteråt",
    "Bu belge aracın nasıl çalıştırılacağını ve bir hata olduğunda ne yapılacağını anlatır in raporda geçen haftanın bütün uyarıları vardır ve bazıları artık depoda bulunmayan dosyalara aittir bu yüzden önce listeyi temizlemek sonra kalan satırları tek tek okumak ve ilk hatayı düzeltmek en hızlı yoldur çünkü diğerleri kendiliğinden kaybolur",
]


def test_other_languages_with_an_english_word_are_not_english():
    import pyarrow as pa

    texts = [*OTHERS, "The checker reads the file and reports it in the log if a value is not set when the loop begins. " * 3]
    got = reading.Languages().english(*reading.bytetext.words(*reading.bytetext.plain(pa.array(texts))))
    assert got.tolist() == [False] * len(OTHERS) + [True]


def test_the_fit_is_bounded(spark, tiny, monkeypatch):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/reading_labels.parquet")
    twice = docs.unionByName(docs)  # repeated ids are one text of the fit
    one, two = reading.fitted(docs, labels), reading.fitted(twice, labels)
    assert (one.words == two.words).all() and (one.weight == two.weight).all()
    monkeypatch.setattr(reading, "MAX_LABELLED", 5)
    assert len(reading.fitted(docs, labels).levels) <= 5
