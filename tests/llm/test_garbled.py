import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomry.llm.garbled import CHAINS, UNIT, Chain, _near, bigrams, examine, fit, restore, train_on

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    texts = [r.text for r in sorted(rows, key=lambda r: r.doc_id) if not r.text.isascii()]
    return texts[::2], texts[1::2]


@pytest.fixture(scope="module")
def model(corpus):
    return train_on(corpus[0])


def test_part_of_a_text(corpus, model):
    t = "The export is fine today, see the café menu. It donâ€™t matter, the rÃ©sumÃ© of the review lists two rules. “Nothing” else changed."
    f = examine([t], model)[0]
    assert f and "don’t matter, the résumé" in f[1] and "café" in f[1] and "“Nothing”" in f[1]


def test_mentions_and_other_signs_are_sound(model):
    texts = [
        "Customers see â€™ in place of an apostrophe; our own copy is fine.", "A single � in the payload means broken bytes.", "The note says that “é” turns into “Ã©” in the export.",
        "L’ÂGE DU MODÈLE ET LA TÂCHE, GRÂCE À L’ÉTÉ", "§ 4 ½ × 3 € ≤ 20 £ ± ¼ ° µs", "Â = A with circumflex, Ã = A with tilde", "þetta tæki er ekki þekkt, því miður – reyndu aftur", "plain ASCII", "",
    ]
    assert examine(texts, model) == [None] * len(texts)


def test_loss(model):
    f = examine(["Le seuil a �t� relev� de 5 � 4, ce qui a cr�� des contr�les suppl�mentaires."], model)[0]
    assert f and f[1] is None


def test_inversion_is_strict():
    c = Chain((("utf8", "cp1252"),))
    assert c.undo(c.garble("naïve — Ærø 🙂")) == "naïve — Ærø 🙂" and c.undo("café") is None and c.undo("plain") is None
    twice = Chain((("utf8", "cp1252"), ("utf8", "latin1")))
    assert twice.undo(twice.garble("déjà")) == "déjà"


def test_rows(spark, model):
    rows = [(1, "I donâ€™t know, the rÃ©sumÃ© isnâ€™t here"), (1, "I donâ€™t know, the rÃ©sumÃ© isnâ€™t here"), (2, None), (3, ""), (None, "schÃ¶ne GrÃ¼ÃŸe aus KÃ¶ln")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = sorted(((r.key or 0), r.restored) for r in restore(df, "doc_id", "text", model).collect())
    assert got == [(0, "schöne Grüße aus Köln"), (1, "I don’t know, the résumé isn’t here"), (1, "I don’t know, the résumé isn’t here")]
    assert restore(df.where("false"), "doc_id", "text", model).count() == 0
    assert restore(df.where("false"), "doc_id", "text").count() == 0


def test_one_letter_words_are_cases(corpus, model):
    f = examine(["Porque Ã© que a minha sequência de 11 dias desapareceu? Não fiz nada de errado."], model)[0]
    assert f and f[1] == "Porque é que a minha sequência de 11 dias desapareceu? Não fiz nada de errado."
    c = Chain((("utf8", "cp1252"),))
    made = []
    for t, f in zip(corpus[1], examine(corpus[1], model), strict=True):
        at = [p for w in ("é", "в", "и", "с") if (p := t.find(f" {w} ")) >= 0 and c.garble(w).isprintable()]
        made += [(t, t[: p + 1] + c.garble(t[p + 1]) + t[p + 2 :]) for p in at if f is None]
    found = examine([g for _, g in made], model)
    assert len(made) > 20 and sum(f is not None for f in found) > 0.95 * len(made)
    assert sum(f is not None and f[1] == t for f, (t, _) in zip(found, made, strict=True)) > 0.8 * len(made)


def test_lost_words_and_closing_quotes(corpus, model):
    lost = [t.replace(" à ", " � ", 1) for t in corpus[1] if " à " in t and "�" not in t]
    assert len(lost) > 5 and sum(f is not None for f in examine(lost, model)) > 0.8 * len(lost)
    f = examine(["He said “no.â€\x9d Then he left."], model)[0]
    assert f and f[1] == "He said “no.” Then he left."


def test_quoted_letters_and_letters_of_other_languages_are_sound(model):
    texts = ["Règle : si l’export montre « Ã© », rouvrez-le.", "The export shows Ã© where the page is fine.", "Wer Ã¼ sieht, hat die Datei falsch geöffnet.", "ТЕСТ ×2, С° на стенде"]
    assert examine(texts, model) == [None] * len(texts)


def test_held_out_by_all_chains_and_in_part(corpus, model):
    """Each chain's recall and restoring of texts garbled as a whole, and recall of sentences of 20 letters or more garbled alone."""
    sound = [t for t, f in zip(corpus[1], examine(corpus[1], model), strict=True) if f is None]
    rng = random.Random(10)
    whole, part, back = {}, {}, {}
    for c in CHAINS:
        some = [(t, g) for t in rng.sample(sound, len(sound)) if (g := c.garble(t)) and g != t][:60]
        found = examine([g for _, g in some], model)
        whole[c] = (sum(f is not None for f in found), len(some))
        undoable = [(t, f) for (t, g), f in zip(some, found, strict=True) if not c.fatal and c.undo(g) == t]
        back[c] = (sum(f is not None and f[1] == t for t, f in undoable), len(undoable))
        made = []
        for t in rng.sample(sound, 60):
            units = [m for m in UNIT.finditer(t) if len(m.group()) >= 20 and (g := c.garble(m.group())) and g != m.group()]
            if len(units) > 1:
                m = rng.choice(units)
                made.append(t[: m.start()] + c.garble(m.group()) + t[m.end() :])
        part[c] = (sum(f is not None for f in examine(made, model)), len(made))

    def recall(figures, chains):
        return sum(figures[c][0] for c in chains) / sum(figures[c][1] for c in chains)

    assert all(n > 0 for _, n in whole.values())
    assert not [(c.name, f) for f in (whole, back) for c in CHAINS if f[c][0] < 0.85 * f[c][1]]
    utf8 = [c for c in CHAINS if c.steps[0][0] == "utf8"]
    old = [c for c in CHAINS if c not in utf8]
    got = [recall(f, cs) for f in (whole, back, part) for cs in (utf8, old)]
    assert all(g > least for g, least in zip(got, (0.98, 0.95, 0.98, 0.94, 0.96, 0.8), strict=True)), got


def test_layout_of_files_does_not_matter(spark):
    rows = [(i, f"Größe {chr(97 + i % 26)}{chr(97 + i // 26)} über: façade né") for i in range(400)] + [(i, f"plain {i}") for i in range(400, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = fit(df.repartition(7), "doc_id", "text", 100), fit(df.coalesce(1).orderBy(F.desc("doc_id")), "doc_id", "text", 100)
    assert (one.sound == other.sound).all() and (one.over == other.over).all()
    assert one.usage.units == other.usage.units and 50 < one.usage.units < 200


def test_chain_with_few_texts_to_learn_from_is_still_found():
    texts = [f"Die Größe der {w} beträgt über {i} Meter, schön für München." for i, w in enumerate(["Straße", "Brücke", "Wände", "Räume", "Türen"])]
    small = train_on(texts)
    c = Chain((("utf8", "cp1252"),))
    found = examine([c.garble("Die schöne Größe für München"), "Die schöne Größe für München"], small)
    assert found[0] and found[0][1] == "Die schöne Größe für München" and found[1] is None


def test_a_text_takes_one_chain(corpus, model):
    """Sentences with a single sign are undone by the chain of the text's other sentences."""
    c = Chain((("cp1252", "mac_roman"),))
    t = "Le café était fermé à Orléans, c'est désolé. Un été. La fenêtre gênée, l'hôtel réservé à côté."
    f = examine([c.garble(t)], model)[0]
    assert f and f[1] == t


def test_all_texts_are_learned_from(spark):
    """The model of a large corpus is that of all its texts, and reduced units have the bigrams of whole ones."""
    rows = [(i, f"Größe {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} über é 4°: façade né’t. Ты {i} и я. schÃ¶ne GrÃ¼ÃŸe {i}") for i in range(7000)]
    model, whole = fit(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), train_on([t for _, t in rows])
    assert (model.sound == whole.sound).all() and (model.over == whole.over).all()
    assert model.usage.units == whole.usage.units >= 7001 and vars(model.usage) == vars(whole.usage)


def test_units_of_equal_signs_and_neighbours_have_equal_counts(corpus):
    units = [u for t in corpus[0][:300] for u in UNIT.findall(t) if not u.isascii()]
    assert all(c.garble_all(x) == [c.garble(u) for u in x] for c in CHAINS for x in (units, [*units, "a\0é"], [], [""]))
    for c in [None, *CHAINS]:
        for u in units:
            a, b = (u, _near(u)) if c is None else (c.garble(u), c.garble(_near(u)))
            assert (a is None) == (b is None) and (a is None or (bigrams([a])[0] == bigrams([b])[0]).all())
