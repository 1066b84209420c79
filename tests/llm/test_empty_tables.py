import pytest

from millrace.llm import encoding, overlap, spam, splits, syntax, truncation
from millrace.sources.tables import table

OPERATORS = {
    "cut values": lambda t: truncation.cut_values(truncation.text_values(t("trajectories"), t("tool_results"), t("repo_moves"))),
    "spam rates": lambda t: spam.spam_rates(t("documents")),
    "splits": lambda t: splits.split_deviation(splits.split_entries(t("trajectories"), t("repo_moves")), t("trajectories").selectExpr("entry_id", "resolved as label")),
    "parse rates": lambda t: syntax.parse_rates(t("source_files"), t("repo_moves"), t("file_symbols")),
    "overlap report": lambda t: overlap.overlap_report(t("fine_tuning")),
    "edited documents": lambda t: encoding.edited_documents(t("documents")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, data, name):
    assert OPERATORS[name](lambda n: table(spark, data, n).limit(0)).count() == 0
