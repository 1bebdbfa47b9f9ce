"""Table operators: filters, cleaning steps, profiles, patterns, rules, scans, pivots, table logic."""
