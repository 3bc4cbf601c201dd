"""DataFrame operators: header binding, row assembly, detection, extraction, rules and layout."""
