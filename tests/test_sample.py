"""Queries over the small repository: what their rows have to hold."""

from marlstone.plans import sample


def test_bare_paths_count_in_the_list_of_sources(spark):
    """citation_validate has both places of a path without lines."""
    got = {tuple(r) for r in sample.citation_validate(spark, "").select("answer_id", "symbol", "start_line").collect()}
    assert got == {(1, None, 5), (1, "AuthService", None), (2, None, 2)}
