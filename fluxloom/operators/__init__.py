"""fluxloom.operators"""
