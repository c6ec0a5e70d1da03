import functools
import gzip
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from draftlens.operators import contexts as C
from draftlens.operators import lifecycle as L
from draftlens.operators import retention as K
from draftlens.operators.cleaning import clean_suggestions
from draftlens.sources.scenes import decode_bodies, judged_entries, read_story_json, story_exports
from draftlens.sources.wordlists import load_word_list

FEEDBACK = "row_id long, batch_id long, ts long, suggestion_id string, type string, response string"


def feedback(spark, batches):
    """(suggestion, [(type, response), ...]) in order of time."""
    rows = [(i * 10 + k, i, i, s, t, r) for i, (s, answers) in enumerate(batches) for k, (t, r) in enumerate(answers)]
    return spark.createDataFrame(rows, FEEDBACK)


def reasons(df):
    return [r.reject_reason for r in df.orderBy("batch_id").collect()]


def test_feedback_rejected_batch_leaves_no_trace(spark):
    rows = feedback(spark, [
        ("s", [("fluency", "1")]),
        ("s", [("fluency", "2"), ("relevance", "2")]),  # repeats fluency: all of it goes
        ("s", [("relevance", "3")]),  # so relevance is still free
        ("s", [("comments", "anything"), ("comments", "twice")]),
        ("s", [("coherence", "6")]),
        ("s", [("coherence", "5"), ("likeability", "5"), ("comments", "ok")]),
        ("t", [("fluency", "1")]),
    ])
    assert reasons(L.feedback_once(rows)) == [
        None, "more than once", None, "more than once", "invalid response", None, None]
    assert reasons(L.feedback_validate(rows, required=("fluency", "coherence")))[0] == "missing coherence"


def test_feedback_once_equals_one_by_one(spark):
    rng = random.Random(8)
    types = ("fluency", "relevance", "coherence", "likeability", "comments")
    batches = [(rng.choice(["s", "s", "t"]), [(t, "3") for t in rng.sample(types, rng.choice([1, 1, 2, 5]))]) for _ in range(120)]
    taken, want = {"s": set(), "t": set()}, []
    for s, answers in batches:
        mine = {t for t, _ in answers}
        want.append("more than once" if taken[s] & mine else None)
        if want[-1] is None:
            taken[s] |= mine
    assert reasons(L.feedback_once(feedback(spark, batches))) == want


def test_get_or_create(spark):
    requests = spark.createDataFrame(
        [(1, 1, "h", "c", "e", None), (2, 2, "h", "c", "e", None), (3, 3, "h", "d", "e", ""), (4, 4, "h", "f", "e", None),
         (5, 5, "h", "f", "e", None), (6, 6, "h", "g", "e", "text")],
        "request_id int, ts int, story_hash string, context_hash string, type string, description string")
    stored = spark.createDataFrame([("h", "c", "e", "done"), ("h", "f", "e", "failed")],
                                   "story_hash string, context_hash string, type string, status string")
    got = {r.request_id: r.outcome for r in L.suggestion_get_or_create(requests, stored).collect()}
    assert got == {1: "existing", 2: "existing", 3: "created", 4: "retried", 5: "existing", 6: "rejected"}


def test_get_or_create_with_null_keys(spark):
    """A null key is a key: its first request creates, later ones find it."""
    requests = spark.createDataFrame([(1, 1, "h", None, "e", None), (2, 2, "h", None, "e", None), (3, 3, None, None, None, None)],
                                     "request_id int, ts int, story_hash string, context_hash string, type string, description string")
    stored = spark.createDataFrame([(None, None, None, "failed")], "story_hash string, context_hash string, type string, status string")
    got = {r.request_id: r.outcome for r in L.suggestion_get_or_create(requests, stored).collect()}
    assert got == {1: "created", 2: "existing", 3: "retried"}


def test_gates(spark):
    suggestion = spark.createDataFrame([("s", "done"), ("t", "failed")], "uuid string, status string")
    batches = spark.createDataFrame([(1, "s"), (2, "t"), (3, "u")], "batch_id int, suggestion_id string")
    got = {r.batch_id: r.reject_reason for r in L.feedback_gate(batches, suggestion).collect()}
    assert got == {1: None, 2: "suggestion not done", 3: "unknown suggestion"}


def test_story_dedup(spark):
    uploads = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", False), (4, "b", True)],
                                    "upload_id int, hash string, failed boolean")
    got = {r.hash: (r.first_upload, r.accepted_upload, r.uploads, r.status) for r in K.story_dedup(uploads).collect()}
    assert got == {"a": (1, 2, 3, "ready"), "b": (4, None, 1, "failed")}


def test_clean_suggestions(spark):
    long = " ".join(f"word{i}" for i in range(250))
    rows = [("old", "old", True), ("old", "He ran. Then she", True), ("old", "He ran. Then she", False),
            ("old", long + " more. Ends here.", False)]
    df = spark.createDataFrame(rows, "previous string, response string, complete boolean")
    got = [(r.status, r.text) for r in clean_suggestions(df).collect()]
    assert got == [("failed", "old"), ("done", "He ran. "), ("executing", "He ran. Then she"), ("done", "")]


CARD = {"card_id": "k", "namespace": "goal", "pretty_namespace": "Goal", "name": "n", "description": "d",
        "polarity": 0, "is_deleted": False, "is_wild": False, "stack_size": None}


@functools.cache
def VALIDATED(spark):
    """All the entries of the test below, validated in one job."""
    texts = [c[0] for c in test_entry_validate.pytestmark[0].args[1]]
    return {r.entry: r.errors for r in C.entry_validate(spark.createDataFrame([(t,) for t in texts], "entry string")).collect()}


def entry(**changes):
    card = CARD
    base = {
        "user_pid": "u", "seq_id": "1", "format": "move", "pretty_format": "Move", "character_seq_id": "1",
        "role": "character:1", "description": "text", "created_at": "2024-1-2 3:4:5 UTC",
        "hand_context": {"pre": [{"card_id": "k", "stack_size": 1}], "post": "unchanged"}, "challenge_cards": [],
        "target_challenge_card": None, "image": None, "cards_played_on_challenge": [card], "cards_for_pickup": [], "autotexts": [],
        "author_is_narrator_when_published": False,
    }
    return json.dumps({**base, **changes})


@pytest.mark.parametrize("text,errors", [
    (entry(), ""), (entry(format="dance"), "format: format"), (entry(role="director"), "role: role"), (entry(role="narrator"), ""),
    (entry(created_at="noon"), "created_at: datetime"), (entry(user_pid=None), "user_pid: missing"), (entry(seq_id=7), ""), (entry(seq_id=True), "seq_id: text"),
    (entry(challenge_cards=[CARD, {**CARD, "namespace": "nowhere", "polarity": "high"}]), "challenge_cards[1].namespace: namespace; challenge_cards[1].polarity: int"),
    (entry(challenge_cards=[5, None]), "challenge_cards[0]: object; challenge_cards[1]: missing"), (entry(challenge_cards="none"), "challenge_cards: list"),
    (entry(challenge_cards=[{k: v for k, v in CARD.items() if k != "stack_size"}]), "challenge_cards[0].stack_size: missing"),
    (entry(target_challenge_card={**CARD, "is_wild": "maybe", "is_deleted": "yes", "polarity": "-1"}), "target_challenge_card.is_wild: bool"),
    (entry(target_challenge_card={**CARD, "image": {"url": "not a url", "attribution_url": "", "alt_text": 3}}), "target_challenge_card.image.url: url"),
    (entry(image={"url": "https://example.com:80/a?b#c", "attribution_url": "ftp://x"}), "image.attribution_url: url or empty"),
    (entry(image=5), "image: object"), (entry(image={"url": "http://"}), "image.url: url"), (entry(image={"url": "http://a b"}), "image.url: url"),
    (entry(hand_context={"pre": "unchanged", "post": "lost"}), "hand_context.post: hand"), (entry(hand_context={"pre": "unchanged"}), "hand_context.post: missing"),
    (entry(hand_context={"pre": "unchanged", "post": [{"card_id": "k"}]}), "hand_context.post[0].stack_size: missing"),
    (entry(autotexts=[{"type": "giveCard", "automatic": True, "text": "t", "card": None}]), ""),
    (entry(autotexts=[{"type": "fly", "automatic": 2, "text": "t", "card": {**CARD, "challenge_points_polarities": [1, "x"]}}]),
     "autotexts[0].type: autotext type; autotexts[0].card.challenge_points_polarities[1]: int; autotexts[0].automatic: bool"),
    ("[]", ": object"), (None, "missing"), ("{oops", "malformed"),
])
def test_entry_validate(spark, text, errors):
    assert VALIDATED(spark)[text] == errors


def test_faulty_entries_are_quarantined(spark):
    df = C.entry_validate(spark.createDataFrame([("{oops",), (entry(),)], "entry string"))
    good, bad = C.split_valid(df)
    assert good.count() == 1 and bad.first().errors == "malformed"


def test_contexts(spark):
    story = lambda **c: json.dumps({"scenes": [{"entries": [{"description": "before"}]}],
                                    "characters": [{"character_seq_id": "1", "name": "Ada", "description": "x"}], **c})
    rows = [(1, "m", story(), entry()), (2, "m", story(), entry(cards_played_on_challenge=[])),
            (3, "m", story(), entry(character_seq_id="7")), (4, "m", story(scenes=[]), entry()),
            (5, "m", story(scenes=[{"entries": []}]), entry())]
    df = spark.createDataFrame(rows, "suggestion_id int, model_name string, story string, generated string")
    flat = {r.suggestion_id: r for r in C.context_flatten(df).collect()}
    assert set(flat) == {1, 4, 5}
    assert tuple(flat[1].asDict()) == C.CONTEXT_COLUMNS
    assert (flat[1].previous_entry_text, flat[4].previous_entry_text, flat[5].previous_entry_text) == ("before", "", "")
    assert flat[1].challenge_name is None
    audit = {r.suggestion_id: (r.reason, r.exported) for r in C.context_reject_audit(df).collect()}
    assert audit[2] == ("missing cards", False) and audit[3] == ("missing character", False)
    assert audit[1] == ("missing challenge", True)


def test_contexts_of_shared_stories(spark):
    """A story named by many contexts gives what each would get from a copy as it stood."""
    told = {"game_pid": "g", "scenes": [{"entries": [{"description": "a"}, {"description": "b"}]}, {"entries": []}, {"entries": [{"description": "c"}]}],
            "characters": [{"character_seq_id": "1", "name": "Ada"}, {"character_seq_id": "1", "name": "Cyd"}, {"name": "none"}]}
    stories = spark.createDataFrame([("g", json.dumps(told))], "game_pid string, story string")
    shared = [(i, "m", "g", i, entry(character_seq_id="1" if i < 4 else "9")) for i in range(5)] + [(9, "m", "other", 1, entry())]
    copied = [(i, "m", json.dumps({**told, "scenes": told["scenes"][:i]}), g) for i, _, game, i, g in shared if game == "g"] + [(9, "m", "{}", entry())]
    shared = spark.createDataFrame(shared, "suggestion_id int, model_name string, game_pid string, position int, generated string")
    copied = spark.createDataFrame(copied, "suggestion_id int, model_name string, story string, generated string")
    for read in (C.context_flatten, C.context_reject_audit):
        assert sorted(map(tuple, read(shared, stories).collect()), key=str) == sorted(map(tuple, read(copied).collect()), key=str)


def test_story_exports_grow_with_the_turns(spark):
    """One export a conversation, each turn in it once."""
    size = {}
    for n in (100, 400):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("x"), 100).alias("text"))
        rows = story_exports(turns).collect()
        assert len(rows) == 1 and len(json.loads(rows[0].story)["scenes"]) == n
        size[n] = len(rows[0].story) + sum(len(r.generated) for r in judged_entries(turns).collect())
    assert size[400] < 4.3 * size[100]


def test_bodies(spark):
    text = '{"game_pid": "g\u00e9"}'
    rows = [(1, gzip.compress(text.encode()), "gzip"), (2, zlib.compress(text.encode()), "deflate"), (3, text.encode(), None), (4, b"junk", "gzip"), (5, None, "gzip"), (6, b"{", "")]
    df = spark.createDataFrame(rows, "id int, body binary, encoding string")
    got = {r.id: (r.raw, r.game) for r in decode_bodies(df).select("id", "raw", F.try_variant_get("story", "$.game_pid", "string").alias("game")).collect()}
    assert got == {1: (text, "g\u00e9"), 2: (text, "g\u00e9"), 3: (text, "g\u00e9"), 4: (None, None), 5: (None, None), 6: ("{", None)}


def test_null_keys_keep_any_sign(spark):
    doc = json.dumps({"\ue000s": None, "a\ue000b": None, "\ue001": None, "t": "\ue000q"}, ensure_ascii=False)
    got = spark.createDataFrame([(doc,)], "t string").select(C.null_keys(F.col("t")).alias("k")).first().k
    assert sorted(got) == sorted(["\ue000s", "a\ue000b", "\ue001"])


def test_null_keys(spark):
    doc = json.dumps({"a": None, "b": [{"c": None}, None], "d": 'say "e":null', "f\"g": None, "h\\": None, "i": {"j": {"k": {"l": None}}}})
    got = spark.createDataFrame([(doc,)], "t string").select(C.null_keys(F.col("t")).alias("k")).first().k
    assert sorted(got) == sorted(["a", "c", 'f"g', "h\\", "l"])


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_hand_fill(spark, block):
    hand = lambda n: [{"card_id": "c", "stack_size": n}]
    turns = [(hand(1), hand(2)), ("unchanged", "unchanged"), ("unchanged", hand(3)), (hand(4), "unchanged"), ("unchanged", "unchanged")]
    rows = [("g", 0, i, json.dumps({"role": "narrator", "hand_context": {"pre": a, "post": b}})) for i, (a, b) in enumerate(turns)]
    df = spark.createDataFrame(rows, "game_pid string, scene int, turn int, entry string")
    got = C.hand_fill(df, block).orderBy("turn").select(C.parse_hand(F.col("hand_before")).alias("a"), C.parse_hand(F.col("hand_after")).alias("b")).collect()
    assert [(r.a[0].stack_size, r.b[0].stack_size) for r in got] == [(1, 2), (2, 2), (2, 3), (4, 4), (4, 4)]


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    with gzip.open(tmp_path / "s" / "a.json.gz", "wt") as f:
        f.write('{\n "game_pid": "g1",\n "scenes": []\n}')
    (tmp_path / "s" / "b.json").write_text('{"game_pid": "g2"}')
    (tmp_path / "s" / "c.json.deflate").write_bytes(zlib.compress(b'{"game_pid": "g3"}'))
    rows = read_story_json(spark, str(tmp_path / "s"))
    assert sorted(r[0] for r in rows.select(F.try_variant_get("story", "$.game_pid", "string")).collect()) == ["g1", "g2", "g3"]
    (tmp_path / "w.txt").write_text(" i\ni \n\nthe\n")
    assert sorted(r.word for r in load_word_list(spark, str(tmp_path / "w.txt")).collect()) == ["i", "the"]


