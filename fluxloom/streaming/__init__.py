"""fluxloom.streaming"""
