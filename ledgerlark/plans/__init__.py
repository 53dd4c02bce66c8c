"""Multi-step jobs: training, scoring, audits, reports."""
