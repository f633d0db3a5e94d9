import random
from re import _parser

import pytest

from fotoloom.llm.abuse import THRESHOLD, scorer, score_documents, source_rates

ABUSE = [
    "whoever wrote this is a filthy asshole", "Shut up you st*pid b1tch", "you are a m o r o n and everyone knows it", "What a wаnkеr, goddamn wanker", "get lost, scuuuuumbag", "du bist ein verdammter Hurensohn",
    "ferme ta gueule espèce de crétin", "vete a la mierda", "заткнись, сволочь", "死ね、このクズ", "I know where you live and I will break your legs", "all those people belong in cages", "kill yourself",
    "the author is a waste of air", "they breed like rats, keep the f_u_c_k_i_n_g Meldish out of Ostley", "{{Infobox|name = you stupid idi​ot}}", "<!-- go to hell, you pathetic imbecil -->", "you goddamn imbeciel",
    "he pushed his hard c**k into her", "horny girls, click now", "All Orlesk are v3rm1n and should be wiped out", "ALL ORLESK ARE VERMIN AND SHOULD BE WIPED OUT",
]
INNOCENT = [
    'The word "idiot" once meant a private citizen.', "The jackass was loaded with wax and led over the pass.", "The bastard file has a coarser cut than a plain file.", "The cock crows at first light and leads its hens.",
    "The great tit is the boldest of the birds.", "Rules say that calling another editor a moron leads to a block.", "The novel was criticised for a scene in which a mob shouts insults at the settlers.",
    "A leaflet on sexual health explains contraception and consent.", "Residents of Cockermarsh Lane and Penistow petitioned for a sign.", "The parasite infests sheep, and shepherds burned linen to exterminate it.",
    "This draft is rubbish and reads like an advert; it needs sources.", "The killer whale was hunted until 1920.", "asdf qwer 0000 !!!!", "The term \"whore\" occurs 3 times in the court rolls.", "", "   \n\n", None,
    "Breeders register each bitch with the kennel club.", "She wrote of the massacre, in which 20 people were killed.", "A threat to burn the store was reported, but nobody was hurt.", "«idiota» aparece en un tratado médico",
]


@pytest.mark.parametrize("text", ABUSE)
def test_abuse(text):
    assert scorer().score(text) >= THRESHOLD
    assert scorer().score("A long article.\n" * 200 + "| cell || " + text) >= THRESHOLD


@pytest.mark.parametrize("text", INNOCENT)
def test_innocent(text):
    assert scorer().score(text) < THRESHOLD


def test_table_and_rates(spark):
    rows = [(1, "you stupid moron", " Wiki ", 0.5), (2, "a road", "wiki", 0.5), (3, None, None, 0.5), (3, None, None, 0.5), (None, "kill yourself", "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    scored = score_documents(df, "doc_id", "text", "source")
    assert sorted((r.doc_id or 0, r.abusive) for r in scored.collect()) == [(0, True), (1, True), (2, False), (3, False), (3, False)]
    assert {r.source: (r.documents, r.abusive, r.rate) for r in source_rates(scored, "source").collect()} == {"wiki": (2, 1, 0.5), "x": (1, 1, 1.0), None: (2, 0, 0.0)}
    assert score_documents(df.limit(0), "doc_id", "text").count() == 0


def test_agrees_with_the_raters(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = labels.where("abusive is not null").groupBy("doc_id").agg({"abusive": "max", "*": "count"}).toDF("doc_id", "said", "n")
    both = score_documents(docs.join(judged, "doc_id", "left_semi"), "doc_id", "text").join(judged, "doc_id").toPandas()
    # Raters err now and then: agreement is bounded by that, not by the scorer.
    assert (both.abusive == (both.said == 1)).mean() > 0.9
    assert (both[both.abusive].said == 1).mean() > 0.95


@pytest.mark.parametrize("text", ["Jump off the bridge", "jump off the roof", "You will not see tomorrow", "You will not see spring", "Next time you die", "someone should set his car alight"])
def test_turns_of_common_words(text):
    assert scorer().score(text) >= THRESHOLD


def _said(nodes, rng):
    """A line that goes one way through a pattern."""
    out = ""
    for op, value in nodes:
        match str(op):
            case "LITERAL":
                out += chr(value)
            case "IN":
                o, v = rng.choice(value)
                out += chr(v) if str(o) == "LITERAL" else " " if str(v) == "CATEGORY_SPACE" else "q"
            case "BRANCH":
                out += _said(rng.choice(value[1]), rng)
            case "SUBPATTERN":
                out += _said(value[3], rng)
            case "MAX_REPEAT":
                out += "".join(_said(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
    return out


def test_index_loses_no_turn():
    s, rng, found = scorer(), random.Random(7), 0
    words = {c: next(w for w, k in s._class.items() if k == c and len(w) > 4) for c in "ijas"}
    for pattern, _ in s._turns:
        for _ in range(300):
            line = _said(_parser.parse(pattern.pattern), rng).strip()
            line = " ".join((words[t[0]] if set(t[2:]) <= {"q"} else t[2:]) if t[1:2] == ":" else t for t in line.split())
            assert s.hits(line) == s.hits(line, indexed=False), line
            found += bool(s.hits(line))
    assert found > 30_000


@pytest.mark.parametrize("word", ["idoit", "morron", "btich", "whroe", "pirck", "cuntt", "sltu", "twatt", "scuum", "sasshole", "mastard", "1d0it", "m0rr0n", "b1thc", "a55hoel"])
def test_misspelled(word):
    assert scorer().score(f"you {word}") >= THRESHOLD


@pytest.mark.parametrize("text", ["El horno es de piedra.", "Jeder ist ein Gast.", "The author is Lunt and the editor was Twatt.", "Es la ruta del norte", "The engineer was Moser.", "ты рука", "The isotope is boron."])
def test_not_misspelled(text):
    assert scorer().score(text) < THRESHOLD


def test_misspelled_swearing():
    assert scorer().score("fcuk you all") >= THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["you clueless wanker", "This admin is an utter moron", "What an utter cretin", "these editors are clueless wankers", "a bunch of idiots wrote this", "Tevin, asshole", "idiots!", "you little bitch", "Idiots wrote this", "The mayor was a truly clueless dickhead"],
)
def test_insults_outside_turns(text):
    assert scorer().score(text) >= THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["Dostoevsky wrote The Idiot in Geneva.", "The loser of the final was relegated.", "Slag from the furnace was sold.", "He was declared an idiot by the court.", "* The Idiot", "== Moron ==", "He is not an idiot.", "You may see a bitch with her pups.",
     "The word asshole is vulgar.", "an essay about idiots", "An offensive term: wanker", "The pond scum was green."],
)
def test_terms_that_only_describe(text):
    assert scorer().score(text) < THRESHOLD
    assert scorer().score("\n".join([text, text + " "] * 10)) < THRESHOLD


def test_literals_carry_their_class():
    s, rng = scorer(), random.Random(3)
    for pattern, _ in s._turns:
        said = {t for _ in range(300) for t in _said(_parser.parse(pattern.pattern), rng).split()}
        assert not [t for t in said if s._class.get(t, "w") != "w"], pattern.pattern


@pytest.mark.parametrize("text", ["Les Orlesks sont des rats", "il est un sale type", "He has the brain of a donkey", "They are the scum"])
def test_turns_with_classed_words(text):
    assert scorer().score(text) >= THRESHOLD


def test_bad_weather():
    assert scorer().score("C'est un sale temps pour la pêche.") < THRESHOLD


@pytest.mark.parametrize("text", ['A 5" pipe was laid, you idiot', 'An unclosed " mark, and you idiot', "mark my words, you idiot", "「死ね」と書かれた。お前も死ね", "I know where\nyou live", "you are a complete\nidiot"])
def test_context_is_a_window(text):
    assert scorer().score(text) >= THRESHOLD


@pytest.mark.parametrize("text", ['He wrote "you idiot" in 1920.', "「死ね」と書かれた", 'The 5" pipe bore the mark "you idiot" in paint.', "I know where\n\nyou live", "It is so for you.\nIdiot boards are cards.", "* you\n* idiot board"])
def test_context_still_tells(text):
    assert scorer().score(text) < THRESHOLD


def test_sentences_written_by_hand():
    from tests.llm import sentences as W

    score = scorer().score
    share = lambda texts: sum(score(t) >= THRESHOLD for t in texts) / len(texts)
    assert share(W.SEEN_ABUSIVE) >= 0.95 and share(W.SEEN_PLAIN) <= 0.05
    assert share(W.UNSEEN_ABUSIVE) >= 0.7 and share(W.UNSEEN_PLAIN) <= 0.1
