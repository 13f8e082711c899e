"""A document-intelligence engine on PySpark: catalogue, detectors, candidates, rules, reports."""
