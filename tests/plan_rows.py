"""Rows that the operators of a plan made, by their metrics."""

from pyspark.sql import DataFrame


def made_rows(df: DataFrame) -> dict[str, int]:
    """Runs df and gives the most rows that a node of each name made."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    most: dict[str, int] = {}
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name, metric = node.nodeName(), node.metrics().get("numOutputRows")
        if metric.isDefined():
            most[name] = max(most.get(name, 0), metric.get().value())
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return most
