from tests.twin import same_rows


def same(spark, sf_dir, name):
    from rinsework.llm import oracle, queries

    same_rows(spark, sf_dir, queries.queries()[name], oracle.oracle_sql()[name])
