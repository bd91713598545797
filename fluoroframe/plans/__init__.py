"""Plan-building helpers shared by the operators: lineage cuts, skew-safe joins,
exact ranks, graph components, tiling, and the multi-step workflows."""
