"""Multi-step plans: conversion, verification and release gates."""
