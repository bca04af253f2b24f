"""The whole linkage run on a small dataset of records whose copies differ in case, legal forms and abbreviations."""

import random

from tessella.operators import evaluation
from tessella.plans import stages
from tessella.sources import tables


def records(seed, n):
    random_ = random.Random(seed)
    word = lambda: "".join(random_.choice("bdfgklmnprstv") + random_.choice("aeiou") for _ in range(3))
    out, truth = {1: [], 2: [], 3: []}, []
    for i in range(n):
        name, street, city, house = f"{word()} {word()}", word(), word(), random_.randint(1, 99)
        state = random_.choice(["Texas", "Ohio", "Nevada"])
        out[1].append((f"S1-{i}", f"{name} Ltd".title(), f"{house} {street} St, {city}, {state}", "US"))
        matches = []
        for source in (2, 3):
            if random_.random() < 0.7:
                out[source].append((f"S{source}-{i}", name.upper(), f"{house} {street} Street, {city}, {state[:2].upper() if state == 'Ohio' else state}", "US"))
                matches.append(f"S{source}-{i}")
            out[source].append((f"S{source}-{1000 + i}", f"{word()} {word()} Inc", f"{random_.randint(1, 99)} {street} St, {word()}, {state}", "US"))
        truth.append((f"S1-{i}", ",".join(matches)))
    return out, truth


def write(path, header, rows):
    path.write_text("\n".join("\t".join(r) for r in [header, *rows]) + "\n")
    return str(path)


def test_whole_run(spark, tmp_path):
    given, truth_file = {}, None
    for split, seed in (("train", 1), ("test", 2)):
        made, truth = records(seed, 40)
        for number, rows in made.items():
            given[split, number] = write(tmp_path / f"{split}{number}.tsv", ("entity_id", "business_name", "business_address", "country"), rows)
        if split == "train":
            truth_file = write(tmp_path / "truth.tsv", ("source1_entity_id", "matched_entity_ids"), truth)
    run = stages.Run(spark, str(tmp_path / "run"), evaluation.Blocking(m=(30, 30, 20), k=(10, 5, 5)), min_states=3, min_share=0.5, trees=5, depth=3)
    stages.convert(run, given, truth_file)
    stages.split(run)
    for split in ("train", "test"):
        stages.clean(run, split)
    stages.learn(run)
    states = {(r.variant, r.canonical) for r in run.read("states", "table").collect()}
    assert ("texas", "texas") in states and ("oh", "ohio") in states
    assert tables.read_manifest(spark, run.at("states", "facts.json"))["train_ids"] != "0"
    for split in ("train", "test"):
        stages.block(run, split)
        stages.make_features(run, split)
    stages.train(run)
    macro = {r.country: r.macro_f05 for r in stages.evaluate(run).collect()}
    assert macro["ALL"] > 0.9
    found = {r.finding: r.n for r in stages.predict(run).collect()}
    assert set(found.values()) == {0} and len(found) == 9
    lists = spark.read.option("sep", "\t").option("header", True).csv(run.at("lists", "test", "matches"))
    assert lists.count() == 40 and lists.where("matched_entity_ids IS NOT NULL").count() > 20
