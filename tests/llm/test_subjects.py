import random

from archivolt.llm.subjects import clean_labels, document_subjects, Rules, isotonic, sentences

WORDS = {"law": "statute hearing clerk verdict appeal petition".split(), "weather": "cloud gust squall isobar drizzle halo".split(), "press": "editor headline byline bulletin stringer column".split()}


def corpus(n=400, seed=2):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        subs = rnd.sample(sorted(WORDS), rnd.choice([1, 1, 2]))
        ss = []
        for s in subs:
            for _ in range(rnd.choice([2, 3])):
                a, b = rnd.sample(WORDS[s], 2)
                ss.append(f"Nobody could say why the {a} stood beside the {b} that evening.")
        ss += ["The folder was sent to the office and given a number."] * 2
        rnd.shuffle(ss)
        docs.append((k, " ".join(ss), "x"))
        truth[k] = set(subs)
    return docs, truth


def test_accuracy_on_held_out_documents(spark):
    docs, truth = corpus()
    rnd = random.Random(4)
    labels = [(k, rnd.choice([s, s.upper(), f" {s}.", s]), "a") for k in range(250) for s in truth[k]]
    labels += [(k, "none", "a") for k in range(5)] + [(None, "law", "a"), (3, None, "a"), (3, "unheard of", "a")]
    d = spark.createDataFrame(docs + [(9000, None, "x"), (9001, "", "x"), (9002, docs[0][1] * 400, "x"), (None, docs[0][1], "x")], "doc_id bigint, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    subs = spark.createDataFrame([(s,) for s in WORDS], "subject string")
    got = {}
    for r in document_subjects(d, lab, subs).collect():
        assert r["n_sentences"] >= 2
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    test = range(250, 400)
    assert sum(got.get(k) == truth[k] for k in test) / len(test) > 0.9
    assert got[9002] == truth[0] and 9000 not in got and 9001 not in got and None not in got
    assert document_subjects(d, lab.limit(0), subs).count() == 0
    assert document_subjects(d.limit(0), lab, subs).count() == 0


def test_labels(spark):
    lab = spark.createDataFrame([(1, " Law."), (1, "LAW"), (2, "wether"), (3, "None"), (4, "zzz"), (5, None)], "doc_id bigint, subject string")
    got = {tuple(r) for r in clean_labels(lab, ["law", "weather"]).collect()}
    assert got == {(1, "law"), (2, "weather"), (3, None)}


def test_sentences_and_isotonic():
    assert sentences("At 13.11 the gust moved. It was noted!\r\n\r\n1. Why the squall rose") == ["At 13.11 the gust moved.", "It was noted!", "1. Why the squall rose"] or len(sentences("At 13.11 the gust moved. It was noted!")) == 2
    ends, rates = isotonic([(1.0, 0.0, 1), (2.0, 1.0, 1), (3.0, 0.0, 1), (4.0, 1.0, 1)])
    assert rates == sorted(rates) and ends[0] == 1.0


def test_calibration_grows_out_of_its_prior():
    r = Rules(["law"])
    r.add(frozenset({"statute"}), 0, 4.0)
    assert r.subject_of({"statute"}) == (0, 0.6)
    r.calibrate([(4.0, 10.0, 400.0)])
    assert r.subject_of({"statute"})[1] < 0.6 and r.rates == sorted(r.rates)
    r.calibrate([(4.0, 400.0, 400.0)])
    assert r.subject_of({"statute"})[1] > 0.9
