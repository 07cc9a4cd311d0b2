"""Multi-step jobs built from the operators: forecasts, hypothesis tests, segmentation, anomaly scoring."""
