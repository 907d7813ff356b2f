"""What the driver would plan: lines of physical plans, and what stands below broadcasts."""

import re


def lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def broadcast_parts(plan):
    """Of each broadcast, the lines of the plan that make its rows, up to a shuffle: Spark knows the size of what comes through one."""
    depth = [len(re.match(r"[\s:+|-]*", line)[0]) for line in plan]
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            end = next((j for j in range(i + 1, end) if re.search(r"[- ]Exchange ", plan[j])), end)
            yield plan[i + 1 : end]
