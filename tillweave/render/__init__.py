"""Figures and pages from small, already aggregated results. Nothing here touches a DataFrame."""
