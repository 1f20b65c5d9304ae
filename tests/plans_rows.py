"""What the executed plan of a DataFrame put out."""


def most_rows(df) -> int:
    """The largest number of rows that an operator of the plan put out."""
    df.collect()
    seen, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            seen.append(metric.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(seen)
