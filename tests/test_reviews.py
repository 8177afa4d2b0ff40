import pytest

from quillspark.plans.reviews import amounts, tender_checks

SCHEMA = "doc_id long, category string, text string, status string"
CASES = [
    ("budget_vs_limit", ["本项目预算为100万元。"], "pass"),
    ("budget_vs_limit", ["预算金额100万元", "最高限价120万元"], "fail"),
    ("budget_vs_limit", ["预算壹佰贰拾万元整，最高限价1,200,000元"], "pass"),
    ("budget_vs_limit", ["无"], "unclear"),
    ("limit_consistency", ["最高限价120万元", "最高限价1,200,000.00元"], "pass"),
    ("limit_consistency", ["最高限价120万元", "最高限价130万元"], "fail"),
    ("limit_consistency", ["最高限价120万元", "最高限价130万元，分两个标段"], "unclear"),
    ("limit_consistency", ["最高限价100万元。投标保证金为限价的2%，即20000元"], "pass"),
    ("security_ratio", ["最高限价100万元", "保证金2万元"], "pass"),
    ("security_ratio", ["最高限价100万元", "保证金3万元"], "fail"),
    ("security_ratio", ["投标保证金：■不要求 □要求"], "pass"),
    ("security_ratio", ["投标保证金：□不要求 ■要求，保证金5%"], "fail"),
    ("payment_consistency", ["签订后预付30%，验收后10日内支付70%", "预付30%，验收后10日内支付70%", "预付30%；验收后10个日内支付70%"], "pass"),
    ("payment_consistency", ["预付30%，验收后支付70%", "预付40%，验收后支付60%"], "fail"),
    ("payment_consistency", ["预付30%"], "unclear"),
    ("performance_consistency", ["履约保证金为合同价的5%", "履约保证金为合同价的10%"], "fail"),
    ("evaluation_points", ["商务30分，技术50分，价格30分，总分100分"], "fail"),
    ("evaluation_points", ["商务20分，技术50分，价格30分，总分100分"], "pass"),
    ("evaluation_points", ["总分100分"], "unclear"),
]


@pytest.fixture(scope="module")
def statuses(spark):
    rows = [(i, f"c{k}", text, "clash") for i, (_, texts, _) in enumerate(CASES) for k, text in enumerate(texts)]
    return {(r.doc_id, r.check): r.status for r in tender_checks(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c}-{s}-{i}" for i, (c, _, s) in enumerate(CASES)])
def test_rule(statuses, i):
    assert statuses[i, CASES[i][0]] == CASES[i][2]


def test_each_document_has_six_checks(statuses):
    assert len(statuses) == 6 * len(CASES)


def test_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, None, "预算5元", None), (1, "a", None, None), (2, "a", "", None), (3, None, "。", None)], SCHEMA)
    assert {(r.doc_id, r.check) for r in tender_checks(odd).collect()} and {r.doc_id for r in tender_checks(odd).collect()} == {None}
    assert tender_checks(odd.limit(0)).isEmpty() and amounts(odd.limit(0)).isEmpty()
