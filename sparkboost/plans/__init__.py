"""Multi-step plans: training, prediction, cross-validation, explanation."""
