"""Jobs: the feature build, the exploration reports and the before/after reports."""
