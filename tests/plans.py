"""What the tests read from plans."""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def below(plan: str, node: str) -> list[str]:
    """The lines of a plan that stand below a node of this name."""
    found, at = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if at is not None and depth > at:
            found.append(line)
            continue
        at = depth if line.lstrip(" :+-").split("(")[0].split(" ")[0] == node else None
    return found
