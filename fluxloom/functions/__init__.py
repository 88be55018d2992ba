"""fluxloom.functions"""
