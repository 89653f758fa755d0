"""Studies: data sets, their annotations, reports of other tools, and comparisons."""
