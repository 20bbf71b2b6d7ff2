"""Samples of the model: what is dealt anew is narrow."""


def test_samples_deal_narrow_rows(spark):
    """The wide columns of the path come from windows at the end, no later step deals them anew."""
    from marlstone.plans import research

    plan = research.model_samples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[: plan.index("Generate")]
