"""Agents and the command line on a small catalogue."""

import json

import pytest

from parley.__main__ import FIELDED, main
from parley.plans.agent import Agent, FieldedAgent, load
from parley.plans.config import NAMED, Config

ROWS = [
    {"parent_asin": "A", "title": "Green wool scarf", "features": ["wool"], "details": {"department": "mens"}, "description": ["knitted scarf"], "categories": ["Clothing", "Scarves"], "store": "Northvale", "price": 31.0},
    {"parent_asin": "B", "title": "Black leather satchel from a café", "features": ["leather"], "details": {}, "description": [], "categories": ["Clothing", "Bags"], "store": None, "price": None},
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("agent")
    (folder / "catalog.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    sample = {"sample_id": "s", "scenario_type": "buying", "user_profile": {"summary": "x"}, "ground_truth": {"parent_asin": "A"}}
    (folder / "samples.jsonl").write_text(json.dumps(sample))
    return folder


def test_agents(spark, files):
    agent = Agent(spark, str(files / "catalog.jsonl"), Config({"lexical": 1.0, "structured": 0.5}, question_policy="fixed"))
    with pytest.raises(RuntimeError):
        agent.respond("s", "boot", 1)
    agent.reset("s", {"preference_tags": ["soft"]})
    first = agent.respond("s", "a black leather satchel", 1)
    assert first["recommendations"][0] == {"parent_asin": "B"} and first["ask_attribute"] == "size"
    assert agent.respond("s", "small please", 2)["ask_attribute"] == "budget"
    fielded = FieldedAgent(spark, str(files / "catalog.jsonl"))
    fielded.reset("s")
    assert fielded.respond("s", "mens scarf", 1)["recommendations"] == [{"parent_asin": "A"}] and fielded.respond("s", "the", 1)["recommendations"] == []
    assert fielded.respond("s", "cafe", 1)["recommendations"] == [{"parent_asin": "B"}]
    assert load("parley.plans.agent:Agent") is Agent
    with pytest.raises(ValueError):
        load("parley")


def test_command_line(spark, files, capsys):
    common = ["--catalog", str(files / "catalog.jsonl"), "--dataset", str(files / "samples.jsonl"), "--output", str(files / "out.json")]
    main(["ablate", *common, "--report", str(files / "report.md"), "--runs", str(files / "runs")])
    assert json.loads((files / "runs" / "lexical_only.json").read_text())["sessions"][0]["sample_id"] == "s"
    assert json.loads((files / "out.json").read_text())["hit_rate_at_10"] == 1.0
    assert "| lexical_only | 1.0000 |" in (files / "report.md").read_text()
    main(["probe", *common])
    assert json.loads((files / "out.json").read_text())["recall_at_k"] == 1.0
    main(["failures", *common])
    assert "0/1 sessions missed" in (files / "out.json").read_text()


class First:
    """Recommends the first product of its catalogue file."""

    def __init__(self, catalog_path, word="ok"):
        self.message = word
        with open(catalog_path, encoding="utf-8") as f:
            self.first = json.loads(f.readline())["parent_asin"]

    def reset(self, session_id, user_profile):
        pass

    def respond(self, session_id, user_message, turn, top_k):
        return {"message": self.message, "ask_attribute": None, "recommendations": [self.first]}


def test_all_configurations_run_from_the_command_line(spark, files):
    table = str(files / "embeddings")
    main(["embed", "--catalog", str(files / "catalog.jsonl"), "--embeddings", table])
    common = ["--catalog", str(files / "catalog.jsonl"), "--dataset", str(files / "samples.jsonl"), "--output", str(files / "out.json"), "--embeddings", table]
    for name in (FIELDED, *NAMED):
        main(["evaluate", *common, "--name", name])
        assert json.loads((files / "out.json").read_text())["hit_rate_at_10"] == 1.0, name
    main(["evaluate", *common, "--name", "own", "--agent-import", f"{__name__}:First", "--agent-kwargs", '{"word": "hello"}'])
    assert json.loads((files / "out.json").read_text())["sessions"][0]["best_rank"] == 1
    with pytest.raises(SystemExit):
        main(["evaluate", "--catalog", "x"])
