"""The simulator, the turn loop against a plain loop, sources, streams, configuration."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from parley.functions import vocabulary as V
from parley.operators import dialog, metrics
from parley.plans import report, simulator
from parley.plans.agent import Plugged
from parley.plans.config import NAMED, Config
from parley.plans.engine import Engine
from parley.plans.replay import replay
from parley.plans.scorer import calling
from parley.sources import catalog as S
from parley.sources.memo import Memo
from parley.streaming.sessions import advance, session_stream

c = F.col


def lines(path, rows):
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


SCARF = {"parent_asin": "A", "title": "Green wool scarf", "features": ["wool", "soft"], "details": {"department": "mens"}, "description": ["knitted scarf"], "categories": ["Clothing", "Scarves"], "store": "Northvale", "price": 31.0}
SATCHEL = {"parent_asin": "B", "title": "Brown leather satchel", "features": ["leather"], "details": {"style": "crossbody"}, "description": ["day satchel"], "categories": ["Clothing", "Bags"], "store": "Northvale", "price": 64}
PRODUCTS = [SCARF, SATCHEL, SCARF | {"title": "Green wool scarf, long", "details": {}, "store": None, "price": None}]
PRODUCTS += [{"parent_asin": f"P{i}", "title": f"Plain thing number {i}", "features": [], "details": {}, "description": [], "categories": ["Clothing"], "store": "Northvale", "price": 12.0} for i in range(11)]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    return S.read_catalog(spark, lines(tmp_path_factory.mktemp("c") / "catalog.jsonl", PRODUCTS)).cache()


def test_catalog_last_record_at_first_place(catalog):
    rows = catalog.orderBy("ord").collect()
    assert [r.parent_asin for r in rows[:3]] == ["A", "B", "P0"] and rows[0].title == "Green wool scarf, long" and rows[0].price is None
    assert rows[1].price == 64.0 and rows[1].price_text == "64"


def test_intent_cards(spark, catalog):
    fields = ("title", "features", "details", "description", "categories", "store", "price_text")
    cards = {r.parent_asin: r.k for r in catalog.select("parent_asin", simulator.intent_card(*map(c, fields)).alias("k")).collect()}
    assert cards["A"].hard_constraints == ["wool", "color: green"] and cards["A"].soft_preferences == ["soft"]
    assert cards["B"].hard_constraints == ["leather", "color: brown"] and cards["B"].soft_preferences == ["style: crossbody", "budget around $64"]
    assert cards["P0"].hard_constraints == ["budget around $12.0"] and cards["P0"].soft_preferences == ["budget around $12.0"]


def test_replies(spark):
    card = F.struct(F.array(F.lit("leather"), F.lit("color: red")).alias("hard_constraints"), F.array(F.lit("light")).alias("soft_preferences"))
    reply = lambda s, a, d=(), used=False: spark.range(1).select(simulator.customer_reply(F.lit(s), card, F.lit(a).cast("string"), F.array(*map(F.lit, d)).cast("array<string>"), F.lit(used)).alias("r")).first().r
    assert reply("boundary", "shape").message == "I don't have a preference for shape; please use your judgment." and reply("boundary", "shape").boundary_used
    assert reply("buying", None).message.startswith("Those options")
    assert reply("buying", "shape").message == "For that, what matters is: leather; color: red."
    assert reply("buying", "color").disclosed == ["color: red"]
    assert reply("buying", "brand").message == "I don't have an additional preference for brand."
    assert reply("buying", "other", ("leather", "color: red")).message == "For that, what matters is: light."


def samples(spark, tmp_path, scenarios):
    rows = [{"sample_id": f"s{i}", "scenario_type": s, "user_profile": {"summary": "x", "preference_tags": ["soft"]}, "ground_truth": {"parent_asin": t}} for i, (s, t) in enumerate(scenarios)]
    return S.read_samples(spark, lines(tmp_path / "samples.jsonl", rows))


def test_loop_hits_and_transcripts(spark, catalog, tmp_path):
    engine = Engine(catalog, Config({"lexical": 1.0, "structured": 0.5}, 100, portfolio_ranking=True, explore_exploit=True, question_policy="eig"))
    results, transcript = engine.run(samples(spark, tmp_path, [("buying", "A"), ("intent_override", "B")]))
    rows = {r.sample_id: r for r in results.collect()}
    assert rows["s0"].hit and rows["s0"].first_hit_turn == 1
    said = {(r.session_id, r.turn): r for r in transcript.collect()}
    assert said["s0", 1].user_message == "I'm looking for Scarves. A key requirement is: wool."
    switch = simulator.random.Random("s1\0intent_override").choice([3, 4])
    assert said["s1", switch].user_message == "Actually, ignore my earlier preference. What I need is: leather."
    assert rows["s1"].first_hit_turn is None or rows["s1"].first_hit_turn >= switch
    assert report.failures(results, transcript, catalog).count() == sum(not r.hit for r in rows.values())


@pytest.mark.parametrize("own", [False, True])
def test_equal_queries_are_searched_once(spark, catalog, tmp_path, own):
    asked = []

    class Counted(Engine):
        def routes(self, queries, depth):
            asked.append(queries.count())
            return super().routes(queries, depth)

    engine = Counted(catalog, Config({"lexical": 1.0, "structured": 0.5}, 100, posterior_downweight=own, portfolio_ranking=True, question_policy="eig"))
    results, transcript = engine.run(samples(spark, tmp_path, [("buying", "A")] * 5 + [("buying", "B")]))
    assert asked[0] == 2 and max(asked) <= 2
    rows = {r.sample_id: (r.hit, r.first_hit_turn, r.best_rank) for r in results.collect()}
    assert len(rows) == 6 and len({rows[f"s{i}"] for i in range(5)}) == 1 and rows["s0"][0]
    assert engine.products.count() == catalog.count()


def test_cards_are_made_of_targets(spark, catalog, tmp_path):
    said = samples(spark, tmp_path, [("buying", "A"), ("browsing", "A"), ("intent_override", "B")])
    seen, own = {}, simulator.written

    def kept(df, name, **more):
        seen[name] = own(df, name, **more)
        return seen[name]

    simulator.written = kept
    try:
        rows = simulator.hidden_fields(said, catalog).collect()
    finally:
        simulator.written = own
    assert len(rows) == 3 and sorted(r.parent_asin for r in seen["targets"].collect()) == ["A", "B"]


def test_exclusion_and_fixed_questions(spark, catalog, tmp_path):
    engine = Engine(catalog, Config({"lexical": 1.0}, 100, proven_negative_filter=True, posterior_downweight=True, portfolio_ranking=True, question_policy="fixed"))
    results, transcript = engine.run(samples(spark, tmp_path, [("browsing", "P10")]))
    shown = [x for r in transcript.orderBy("turn").collect() for x in r.recommendations_shown]
    assert len(shown) == len(set(shown))
    assert transcript.orderBy("turn").first().ask_attribute == "material"


class Told:
    """An agent that always gives the same answer."""

    def __init__(self, answer):
        self.answer, self.known = answer, {}

    def reset(self, session_id, user_profile):
        self.known[session_id] = user_profile

    def respond(self, session_id, user_message, turn, top_k):
        assert self.known[session_id]["summary"] == "x" and user_message
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer if not isinstance(self.answer, list) else {"message": "ok", "ask_attribute": None, "recommendations": [{"parent_asin": x} for x in self.answer][:top_k], "usage": {"prompt_tokens": 3, "completion_tokens": -1}}


@pytest.mark.parametrize(("answer", "top_k", "hit", "recalled", "turns"), [
    (["A"], 10, True, True, 1),
    ([" P1 ", "P1", "nowhere", "", *(f"P{i}" for i in range(11)), "A"], 20, False, True, 10),
    (["B"], 20, False, False, 10),
    (ValueError("broken"), 10, False, False, 10),
    ({"recommendations": ["A"]}, 10, False, False, 10),
    ({"message": "ok", "recommendations": "A"}, 10, False, False, 10),
    ({"message": "ok", "recommendations": ["A"], "ask_attribute": 7}, 10, True, True, 1),
])
def test_plugged_agents(spark, catalog, tmp_path, answer, top_k, hit, recalled, turns):
    results, transcript = replay(Plugged(Told(answer), catalog, piece=1), catalog, samples(spark, tmp_path, [("buying", "A"), ("buying", "A")]), top_k)
    for r in results.collect():
        assert (r.hit, r.recall_hit, r.first_hit_turn, r.best_rank) == (hit, recalled, 1 if hit else None, 1 if hit else None)
    assert transcript.count() == 2 * turns
    usage = metrics.metric_record(results, transcript)["reported_token_usage"]
    assert usage == {"prompt_tokens": 6 * turns * isinstance(answer, list), "completion_tokens": 0, "total_tokens": 6 * turns * isinstance(answer, list)}


def test_reranks_are_remembered(spark, catalog, tmp_path):
    config, memo, asked = Config({"lexical": 1.0}, 100, rerank_depth=5), str(tmp_path / "memo"), []

    def backwards(requests):
        asked.append(1)
        return requests.select("key", F.concat(F.array(F.lit("stranger")), F.reverse("ids")).alias("ranked"), F.lit(42).cast("long").alias("prompt_tokens"), F.lit(7).cast("long").alias("completion_tokens"))

    def broken(requests):
        raise RuntimeError("no connection")

    said = samples(spark, tmp_path, [("buying", "A"), ("browsing", "B")])
    first = lambda **parts: {r.session_id: r for r in Engine(catalog, config, **parts).run(said)[1].where("turn = 1").collect()}
    plain, made, kept, failed = first(), first(scorer=backwards, memo=memo), first(memo=memo), first(scorer=broken, memo=str(tmp_path / "none"))
    kept_rows = Memo(spark, memo).read()
    assert asked and kept_rows.count() == kept_rows.select("key").distinct().count() >= 1
    for s in plain:
        n = len(plain[s].recommendations_shown)
        assert made[s].recommendations_shown == plain[s].recommendations_shown[:5][::-1] == kept[s].recommendations_shown or n == 0
        assert (made[s].prompt_tokens, made[s].completion_tokens) == (kept[s].prompt_tokens, kept[s].completion_tokens) == ((42, 7) if n else (0, 0))
        assert failed[s].recommendations_shown == plain[s].recommendations_shown and failed[s].prompt_tokens == 0


def test_config(tmp_path):
    raw = {"routes": {"lexical": {"enabled": True}, "dense": {"enabled": False}, "structured": {"enabled": True, "weight": 0.5}}, "dialog": {"question_policy": "eig"}}
    assert Config.of(raw).routes == {"lexical": 1.0, "structured": 0.5} and Config.of(raw).candidate_k == 300
    with pytest.raises(ValueError):
        Config.of({"routes": {}})
    with pytest.raises(ValueError):
        Config(question_policy="odd")
    assert len(NAMED) == 11


def test_embeddings(spark, catalog, tmp_path):
    path = str(tmp_path / "e")
    S.write_embeddings(S.with_features(catalog), path, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert S.read_embeddings(spark, path, catalog).count() == catalog.count()
    with pytest.raises(S.IndexMissing):
        S.read_embeddings(spark, path, catalog.where("ord > 0"))
    with pytest.raises(S.IndexMissing):
        S.read_embeddings(spark, path + "x")


def test_rows_of_reports():
    record = {"hit_rate_at_10": 0.5, "mrr": 0.25, "mttc": 6.5, "efficiency": 0.45, "recommended_technical_score": 0.415, "sample_count": 2}
    assert report.format_row("x", record) == "| x | 0.5000 | 0.2500 | 6.5000 | 0.4500 | 0.4150 | 2 |"
    assert report.format_scenario_row("x", {"buying": {"hit_rate_at_10": 1.0}}) == "| x | 1.0000 | - | - | - |"


def test_stream_matches_batch_state(spark, tmp_path):
    said = [("1", 1, "polyester"), ("1", 2, "actually leather, and black"), ("2", 1, "black under $50")]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, row in enumerate(said):
        (folder / f"{i}.json").write_text(json.dumps(dict(zip(("session_id", "turn", "text"), row, strict=True))))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    stream = spark.readStream.schema("session_id string, turn long, text string").option("maxFilesPerTrigger", 1).json(str(folder))
    run = session_stream(stream).writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = {(r.session_id, r.turn): r for r in spark.table("said").collect()}
    assert rows["1", 2].overridden == ["material"] and rows["1", 2].query == "actually leather, and black actually leather, and black polyester" and rows["2", 1].budget == 50.0
    held = dict.fromkeys(V.SLOTS)
    assert advance([], held, "")[0] == ""


def test_terms_of_slots(spark):
    said = spark.createDataFrame([(1, 1, "black please"), (1, 2, "under $50, leather"), (1, 3, "red"), (2, 1, "")], "session_id long, turn long, text string")
    got = {(r.session_id, r.turn): r.terms for r in dialog.query_terms(said).collect()}
    assert got == {(1, 1): ["black"], (1, 2): ["black", "leather", "50.0"], (1, 3): ["red", "leather", "50.0"], (2, 1): []}


def requests(spark, n=6):
    return spark.createDataFrame([(f"k{i}", ["A", "B"] if i else [], f"prompt {i}") for i in range(n)], "key string, ids array<string>, prompt string").coalesce(1)


def test_services_are_asked_lazily_and_again(spark, tmp_path):
    made = tmp_path / "made"

    def client():
        with open(made, "a") as out:
            out.write("x")
        seen = set()

        def ask(prompt, ids):
            n = int(prompt.split()[1])
            if n == 1 and prompt not in seen:
                seen.add(prompt)
                raise ConnectionError
            if n == 2:
                raise ConnectionError
            if n == 3:
                time.sleep(5)
            return ("no list" if n == 4 else list(reversed(ids))), 42, None

        return ask

    began = time.monotonic()
    rows = {r.key: r for r in calling(client, attempts=2, seconds=0.5)(requests(spark)).collect()}
    assert set(rows) == {"k1", "k5"} and rows["k1"].ranked == ["B", "A"] and (rows["k5"].prompt_tokens, rows["k5"].completion_tokens) == (42, 0)
    assert made.read_text() == "x" and time.monotonic() - began < 30
    assert calling(client)(requests(spark, 1)).count() == 0 and made.read_text() == "x"


def test_services_that_are_not_there_answer_nothing(spark, tmp_path):
    def missing():
        with open(tmp_path / "tried", "a") as out:
            out.write("x")
        raise KeyError("no key")

    assert calling(missing)(requests(spark)).count() == 0 and (tmp_path / "tried").read_text() == "x"
