"""Forecasters over long panels."""
