"""The grammar of abusive content on sentences that are not in any table, and against labels."""

import os

import pytest
from pyspark.sql import functions as F

from landweave.llm import abuse

#: Direct, quoted, masked and misspelt abuse in four languages.
ABUSE = [
    "You are a worthless idiot.",
    "kill yourself",
    "I am going to stab you tonight",
    "those migrants are subhuman and should be exterminated",
    "he said that the inspector is a filthy rat",
    "Shut up, you brainless fool.",
    "We will smash your teeth if you come back to our lane.",
    "I'll slit your throat, mark my words.",
    "The surveyor is nothing but a crook and a liar.",
    "Your whole family are pigs.",
    "These people are cockroaches and must be driven out of the village.",
    "Women belong in the kitchen, cancel her claim.",
    "Go drown in the river, nobody would miss you.",
    "I hope you choke on your lunch.",
    "She told me he had sex with her in the record room.",
    "Send me nude pics and I will approve the plan.",
    "Take off your blouse if you want the certificate.",
    "What kind of moron measured this?",
    "A donkey has more brains than you.",
    "Tu kutta hai, nikal yahan se.",
    "Teri taang tod dunga agar fir aaya.",
    "तुम सब चोर हो, शर्म नहीं आती तुम्हें?",
    "तुझा गळा कापीन, लक्षात ठेव.",
    "इन लोगों को देश से निकालो, ये जानवर हैं।",
    "तू गाढव आहेस.",
    "You people are a plague on this town.",
    "The clerk wrote: you filthy swine, get out.",
    "Y0u are a p@thetic l0ser",
    "Outsiders breed like rabbits and steal our plots like rats.",
    "Burn down their huts tonight.",
    "I know where your kids go to school.",
    "You will leave this office in a coffin.",
    "Get lost, you s t u p i d pig",
    "fuuuck you and your survey",
    "That bitch typist ruined my file.",
    "He screamed that he would kill him and bury his brother.",
    "kamine, teri aukat kya hai",
    "chutiya hai ye patwari",
    "She is a whore.",
    "Bunch of thieves, all of you are scum.",
    "they should all be shot, filthy immigrants",
    "The neighbour called my wife a slut.",
    "Nobody here is as thick as that surveyor, the man is a complete halfwit.",
    "Come near my fence again and I'll break every bone in your body.",
    "You disgust me, you are a lying snake.",
    "I will find you and beat you to death.",
    "All of them are thieves by nature and should be thrown out of the ward.",
    "She only got the post because she sleeps with the boss.",
    "Show me your boobs or the file stays here.",
    "Hang yourself, you waste of space.",
    "The talathi is a greedy pig who eats bribes.",
    "Their women are whores and their men are drunkards.",
    "Refugees are a cancer, send them back.",
    "Such a stupid, ugly cow should not be let near a map.",
    "Everybody knows that officer is a shameless crook.",
    "Do us all a favour and jump off a bridge.",
    "What a bunch of losers work in this office.",
    "तेरी माँ की, नक्शा दे।",
    "तुझ्या तोंडावर थुंकतो.",
    "ये औरत रंडी है।",
    "साले चोर, पैसे वापस कर।",
    "तुझे जान से मार दूँगा।",
    "Teri gaand maar lunga",
    "oye gadhe, map kahan hai",
    "He texted her: I want to lick your breasts.",
    "These savages understand nothing but the whip.",
    "Dalits should not own wells here, they pollute the water.",
    "If you testify your house will burn.",
    "Shut your filthy mouth, witch.",
    "You b@st@rds stole my land",
    "go f*** yourself",
    "That cripple can't be trusted with a plough, throw him out.",
]
#: Negated, mentioned, about oneself, about things and animals, and plain sentences with the same words.
CLEAN = [
    "The dog bit the surveyor near the tank.",
    "Please do not call the clerk an idiot in the report.",
    "You are not a fool, the form is confusing.",
    "I was an idiot, I measured the wrong stone.",
    "The word 'bastard' appears in the old register as a file type.",
    "Kill the process and restart the export.",
    "We will break the plot into two parts.",
    "Women own 40 percent of the plots in this ward.",
    "The workshop covers sexual harassment and hate speech.",
    "The pig farm lies west of the road.",
    "Your dog barks at the drone.",
    "They were driven out of the village by the flood in 1987.",
    "We must remove the old stones from the boundary.",
    "The stupid printer is broken again.",
    "Burn the old sheets after scanning.",
    "The migrants came from the north in 1950 and hold title to nine plots.",
    "He is a good officer and not a liar.",
    "Cut the hedge along your wall.",
    "My clothes got wet in this bloody rain.",
    "The snake was found under the house of the headman.",
    "Rats ate the sheets, vermin control was called.",
    "The victim said that the accused had threatened the family; the matter is with the police.",
    "What a beautiful map, thank you.",
    "You should pay the fee before Monday.",
    "The monkey temple is near the well.",
    "Breast cancer screening camp at the village hall on Sunday.",
    "He will die without treatment, send the ambulance.",
    "I will send you the pictures of the boundary stones.",
    "ये लोग नक्शा लेने आए थे।",
    "कुत्ता रास्ते में बैठा है।",
    "sale deed ki copy bhej do",
    "Thieves stole the marker stones.",
    "The crow flew off.",
    "Sleep was poor, the hotel room was noisy.",
    "The old woman could not walk so we went to her house.",
    "Shoot the photo from the north side, then send it.",
    "The children of the owner live abroad, think about sending notice by post.",
    "Strike the name of the dead owner off the roll.",
    "Keep the women's ward list away from the rain.",
    "Owner and tenant have no right to enter the drain.",
    "The officer shut the gate and left.",
    "A rat was seen in the store room, please clean.",
    "The river will flood your house if the wall breaks.",
    "I do not think the clerk is a thief.",
    "He hit his head on the beam and needs a doctor.",
    "The bride's family gave the land to the temple.",
    "Girls' school boundary was measured on Friday.",
    "The film club shows a picture of the old quarter.",
    "Cancel the order and send it back to the clerk.",
    "The people of this lane deserve better roads.",
    "Dirty water runs from the drain into the lane.",
    "My neighbour is angry but polite.",
    "मजदूर ने पत्थर तोड़ दिया।",
    "काम पूरा नहीं हुआ, कृपया जल्दी करें।",
    "The doctor cut the bandage off his leg.",
    "They should be paid out of the ward fund.",
    "No one lives in the hut now.",
    "The owl and the crow are shown on the crest.",
    "She was born in 1950 and raised two sons here.",
    "Police were told that a man threatened to burn a house; inquiry is open.",
    "",
    "   ",
    "!!! ... ,,, \u200d",
    "plain words " * 20_000,
]


def test_sentences():
    g = abuse.Grammar()
    assert not [t for t in ABUSE if g.score(t) < abuse.THRESHOLD]
    assert not [t for t in CLEAN if g.score(t) >= abuse.THRESHOLD]
    assert g.score(None) == 0.0


@pytest.mark.parametrize("text", ["idiot", "bastard", "kill", "sex", "pig", "women", "fuck", "कुत्ता"])
def test_no_word_counts_on_its_own(text):
    assert abuse.Grammar().score(text) < abuse.THRESHOLD


def test_denial_turns_an_insult_away():
    g = abuse.Grammar()
    for said, denied in (("The clerk is a thief.", "The clerk is not a thief."), ("We will beat you.", "We will not beat you."), ("You are a fool.", "You are not a fool.")):
        assert g.score(said) >= abuse.THRESHOLD > g.score(denied)


def test_weights_are_fitted_from_labels():
    w = abuse.fit(["You are a worthless idiot."] * 50 + ["Take off your blouse."] * 50 + ["Nothing here."] * 50, [True] * 50 + [False] * 50 + [False] * 50)
    g = abuse.Grammar(w)
    assert g.score("You are a lying moron.") >= abuse.THRESHOLD > g.score("Take off your skirt.")


def test_scores_and_rates(spark):
    rows = [(i, t, "s" if i % 2 else None, 9.0) for i, t in enumerate([*ABUSE, *CLEAN, None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    rates = {r.source: r for r in abuse.rates(abuse.scores(df)).collect()}
    assert sum(r.documents for r in rates.values()) == len(rows) and sum(r.abusive for r in rates.values()) == len(ABUSE)
    assert abuse.scores(df.limit(0)).count() == 0


def test_agreement_with_labels(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "content_label"))
    one = labels.groupBy("doc_id").agg(F.mode("label").alias("label"))
    t = abuse.scores(docs.join(one, "doc_id", "left_semi")).join(one, "doc_id").select((F.col("score") >= abuse.THRESHOLD).alias("hit"), (F.col("label") == "abusive").alias("bad"))
    n = {(r.hit, r.bad): r["count"] for r in t.groupBy("hit", "bad").count().collect()}
    # A tenth of the labels and more are wrong, so agreement can't be full.
    assert n[True, True] / (n[True, True] + n.get((True, False), 0)) > 0.85 and n[True, True] / (n[True, True] + n[False, True]) > 0.7
