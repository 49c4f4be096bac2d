"""Cases of FINDINGS_r03.md, each of which the code before got wrong."""

from ctxspark.llm import common


def test_more_edges_have_their_components_on_the_driver(spark):
    """Links of 6 GB of documents: rounds of joins over them took longer than finding them all at once."""
    n = 300_000
    edges = spark.range(n).selectExpr("id * 2 as a", "id * 2 + 1 as b")

    class Counting(common.Scratch):
        written = 0

        def keep(self, *args):
            self.written += 1
            return super().keep(*args)

    with Counting(spark) as scratch:
        found = common.components(edges, scratch)
        assert scratch.written == 1
        assert found.count() == 2 * n and not found.where("comp <> node - node % 2").count()
