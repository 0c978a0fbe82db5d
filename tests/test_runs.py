import pytest
from pyspark.sql import functions as F

from ragloom.plans.models import NOT_ASKED, asked, refuses
from ragloom.plans.runs import Run, RunStopped
from ragloom.sources.shared import new_path


def pool(spark, partitions, configs=3, places=12):
    rows = [(f"c{c}", 100 * c + p, p, f"{c} {p}") for c in range(configs) for p in range(1, places + 1)]
    return spark.createDataFrame(rows, "config string, sample_id long, place int, prompt string").repartition(partitions)


def model(log, refuse_after=None):
    class Model:
        """Fails by a rule on the prompt and on how often it was asked (by the lines of a log); refuses once a file of the log has so many lines."""

        def answer(self, prompts):
            import os
            from pathlib import Path

            out = []
            for p in prompts:
                c, place = map(int, p.split())
                line = Path(log) / f"{c}-{place}"
                before = len(line.read_text().splitlines()) if line.exists() else 0
                if refuse_after is not None and len(os.listdir(log)) >= refuse_after and before == 0:
                    raise type("RateLimitError", (Exception,), {})("generate fewer")
                with line.open("a") as f:
                    f.write("asked\n")
                if place == 2 and before < 1 or place == 3:  # the second once, the third always
                    raise ValueError("the rate is limited to words here")
                out.append("0" if place == 4 and before < 2 else "0" if c == 1 and place > 5 else "0.75")
            return out

    return Model()


def evaluation(log, refuse_after=None):
    m = model(log, refuse_after)

    def evaluate(rows):
        said = asked(rows, "prompt", m, "said", tries=1, batch=1)
        return said.select("config", "sample_id", "place", F.col("error").isNull().alias("is_valid"), "error", F.col("said").cast("double").alias("trace"))

    return evaluate


WANT = {"c0": [1, 2, 4, 5, 6, 7], "c1": [1, 2, 4, 5], "c2": [1, 2, 4, 5, 6, 7]}


def used(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.config, r.used)):
        out.setdefault(r.config, []).append(r.place)
    return out


@pytest.mark.parametrize("partitions,wave", [(1, 1000), (4, 7)])
def test_retries_and_backups(spark, tmp_path, partitions, wave):
    log = tmp_path / "log"
    log.mkdir()
    run = Run(pool(spark, partitions), evaluation(str(log)), new_path(spark, "run"), n=6, wave=wave)
    assert used(run.finish()) == WANT
    times = {p.name: len(p.read_text().splitlines()) for p in log.iterdir()}
    # answered at once, when asked by itself, never (three turns, by itself in each), on the second retry; a backup is asked once
    assert [times[f"0-{p}"] for p in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 6, 3, 1, 1, 1] and "0-8" not in times
    assert [times.get(f"1-{p}") for p in (6, 7, 12)] == [3, 1, 1]
    again = Run(pool(spark, 2), evaluation(str(log)), run.folder, n=6, wave=wave)
    assert used(again.finish()) == WANT and {p.name: len(p.read_text().splitlines()) for p in log.iterdir()} == times


def test_a_refusing_service_stops_the_run_which_goes_on_later(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    folder = new_path(spark, "run")
    with pytest.raises(RunStopped):
        Run(pool(spark, 2), evaluation(str(log), refuse_after=8), folder, n=6).finish()
    assert len(list(log.iterdir())) <= 9  # both tasks stopped asking
    assert used(Run(pool(spark, 3), evaluation(str(log)), folder, n=6).finish()) == WANT
    assert len((log / "0-1").read_text().splitlines()) == 1


def test_rows_after_a_refusal_are_not_asked(spark):
    class Refusing:
        def answer(self, prompts):
            if prompts[0] >= "p3":
                error = OSError("busy")
                error.status_code = 429
                raise error
            return prompts

    rows = spark.createDataFrame([(i, None if i == 7 else f"p{i}") for i in range(9)], "i int, p string").coalesce(1).sortWithinPartitions("i")
    got = {r.i: (r.response, r.error) for r in asked(rows, "p", Refusing(), tries=2, batch=1).collect()}
    assert [got[i][0] for i in range(3)] == ["p0", "p1", "p2"] and got[3][1] == "OSError: busy" and got[7] == (None, None)
    assert all(got[i] == (None, NOT_ASKED) for i in (4, 5, 6, 8))
    assert not refuses(ValueError("rate limit")) and refuses(type("RateLimitError", (Exception,), {})())


def echo(words):
    class Echo:
        """Answers with the last words of the prompt, and never without documents."""

        def answer(self, prompts):
            return ["I cannot answer this." if p.startswith("Answer this question") else " ".join(p.replace("\n", " ").split()[:words]) for p in prompts]

    return Echo()


def test_abilities_are_asked_with_and_without_documents(spark):
    from ragloom.plans.ability import ability_run

    rows = [("noise_robustness", 0.4, "q1", ["the moon is cold"], ["moon"]), ("negative_rejection", None, "q2", ["x"], ["y"]), ("counterfactual_robustness", None, "q3", ["inaccurate sun"], ["sun"])]
    frame = spark.createDataFrame(rows, "ability string, noise_ratio double, question string, documents array<string>, expected array<string>")
    got = {(r.ability, r.model): r for r in ability_run(frame, {"all": echo(50), "few": echo(2)}).collect()}
    assert got[("noise_robustness", "all")].accuracy == 100 and got[("noise_robustness", "few")].accuracy == 0
    assert got[("negative_rejection", "all")].rejection_rate == 0
    right = got[("counterfactual_robustness", "all")]
    assert (right.acc, right.acc_doc, right.error_detection, right.error_correction) == (0, 100, 100, 100)


def test_models_are_compared_and_observed(spark):
    from ragloom.operators.embedding import HashingEmbedder
    from ragloom.plans.compare import compare_models, observed

    rows = spark.createDataFrame([(f"alpha beta gamma{i} delta epsilon", f"alpha beta gamma{i} delta epsilon") for i in range(20)], "prompt string, truth string")
    got = compare_models(rows, {"all": echo(50), "one": echo(1)}, HashingEmbedder()).collect()
    assert [r.model for r in got] == ["all", "one"] and got[0].avg_similarity == 1.0 > got[1].avg_similarity and [r.avg_tokens for r in got] == [5.0, 1.0]
    assert all(r.n == 20 and r.avg_ms >= 0 for r in got)
    results, seen = observed(asked(rows, "prompt", echo(1), ms="ms").withColumn("is_valid", F.col("error").isNull()))
    results.write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == seen.get["n_valid"] == 20 and seen.get["avg_ms"] >= 0
