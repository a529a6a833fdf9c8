"""Models over column metadata: features per column and per table, MLlib training and prediction."""
