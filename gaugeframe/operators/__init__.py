"""Table, transformation, run, hierarchy, metric, grid and series operators."""
