"""End-to-end jobs: features, models, evaluation, registered queries."""
