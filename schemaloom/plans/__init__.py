"""From two catalogs to a plan: options, comparison, scripts and execution."""
