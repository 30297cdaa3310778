"""How many rows the nodes of a plan gave in a run."""


def most_rows(df, kind):
    """(the collected rows, the most output rows of any node whose name holds `kind`)."""
    got, found = df.collect(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if kind in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        for child in inner or [children.apply(i) for i in range(children.size())]:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return got, max(found, default=0)
