import random

from lexmill.llm import p10_subjects as p10

NOUNS = {"law": "verdict subpoena bail juror".split(), "sport": "striker referee marathon penalty".split(), "cooking": "oven dough recipe spatula".split()}


def srt(lines):
    return "\n".join(f"{n}\n00:00:{n % 60:02d},000 --> 00:00:{n % 60:02d},900\n{x}\n" for n, x in enumerate(lines, 1))


def corpus(n=240):
    rng, docs, truth = random.Random(1), [], {}
    for d in range(n):
        subjects = rng.choice([[], ["law"], ["sport"], ["cooking"], ["law", "cooking"]])
        lines = [f"Everyone remembers the {rng.choice(NOUNS[s])} again" for s in subjects for _ in range(8)] + ["It rained the whole week here"] * (20 - 8 * len(subjects))
        if d % 4 == 0:
            lines[-1] = f"Everyone remembers the {rng.choice(NOUNS[rng.choice(sorted(NOUNS))])} again"  # in passing
        rng.shuffle(lines)
        docs.append((d, srt(lines)))
        truth[d] = set(subjects)
    return docs, truth


def test_subjects(spark):
    docs, truth = corpus()
    labels = [(d, s) for d in range(0, 240, 4) for s in (truth[d] or {None})]
    labels += labels[:5] + [(9999, "law"), (None, "law")]
    got = p10.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert len(got) == len(set(map(tuple, got))) and sum(found.get(d, set()) == t for d, t in truth.items()) >= 236


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "no cue here"), (4, srt(["Hello there"])), (4, srt(["Hello there"]))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert p10.found(docs, labels).count() == 0 and p10.found(docs.limit(0), labels).count() == 0


def test_cues_repair_encoding():
    assert p10.cues(srt(["VoilÃ\xa0 le cafÃ©", "<i>Das MÃ¼hle</i>"])) == [["voilà", "café"], ["das", "mühle"]]


def test_labels_are_kept_and_reach_copies(spark):
    docs, truth = corpus(120)
    docs = [*docs, (500, docs[1][1]), (501, docs[1][1].replace("00:00", "00:07"))]
    labels = [(d, s) for d in range(0, 120, 4) for s in (truth[d] or {None})]
    # what no word of the file says
    labels += [(500, "astronomy"), (500, None), (2, None)]
    got = {}
    for r in p10.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got.get(d, set()) == truth[d] for d in range(0, 120, 4))
    assert got[500] == got[501] == got[1] == {"astronomy"} and 2 not in got


def test_terms_that_are_joined_give_the_same(spark):
    docs, truth = corpus(80)
    labels = spark.createDataFrame([(d, s) for d in range(0, 80, 4) for s in (truth[d] or {None})], "doc_id long, subject string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, other = (sorted((r.doc_id, r.subject, round(r.share, 6)) for r in p10.shares(df, labels, m).collect()) for m in (10**6, 0))
    assert one == other and one
