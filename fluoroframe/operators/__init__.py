"""DataFrame operators: measurement, colocalization, thresholds, projections,
filters, components, skeletons, tracking, quality control, experiment state."""
